"""Repair of the turn structure of conversations by the cheapest edits.

An edit script spells one letter per edit: D deletes a row, I inserts a turn without text, K keeps a row, R gives a row
another role. A whole script is one integer: its high digits carry the cost and, below them, each letter has a digit of
fixed width at its place, so that unused places at the end are zero. The least integer is then the cheapest script and,
among equally cheap ones, the least in ASCII order; a dynamic program over rows and four states takes minima of integers.
A shorter script never wins against a longer one that it begins: both would end in the same state, and the rest of the
longer one would be inserts in a circle, which cost something.

Long conversations pass in blocks of rows: what the scripts of all states have in common is settled, hashed or returned
at the end of a block, and only their tails go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, UNMENDED = 0, 3, 4, 3, 3
LETTERS = "\0DIKR"
WIDTH = 3
BLOCK = 512

# States by what the script has given so far: nothing, a system turn, up to a user turn, up to an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn of the role that a state waits for, and that role.
AFTER = (USER, USER, ASSISTANT, USER)
WANTED = ("user", "user", "assistant", "user")
ROLES = "sua"

Entry = tuple[int, str] | None


def kept_state(state: int, initial: str) -> int | None:
    """The state after a kept row, None where its role cannot stand."""
    if initial == WANTED[state][0]:
        return AFTER[state]
    return SYSTEM if state == START and initial == "s" else None


def _with_inserts(best: list, bits: int) -> list:
    """``best`` with inserts wherever they are cheaper; two in a row suffice, three come back to the same state."""
    best = list(best)
    for state in (START, SYSTEM, ASSISTANT, USER):
        if best[state]:
            weight, place = best[state]
            found = (weight + (INSERT << bits) + (LETTERS.index("I") << place), place - WIDTH)
            if not best[AFTER[state]] or found < best[AFTER[state]]:
                best[AFTER[state]] = found
    return best


@lru_cache(100_000)
def scripts(entries: tuple[Entry, ...], rows: tuple[tuple[str, int], ...], last: bool) -> tuple[Entry, ...]:
    """The best (cost, letters) per state after ``rows`` of (initial, fault), from those before them.

    At the end of the conversation (``last``) only the best accepted one is returned.
    """
    longest = max(len(e[1]) for e in entries if e)
    bits = WIDTH * (longest + 3 * len(rows) + 3)

    def packed(entry: Entry):
        if entry is None:
            return None
        digits = 0
        for letter in entry[1]:
            digits = digits << WIDTH | LETTERS.index(letter)
        place = bits - WIDTH * len(entry[1])
        return entry[0] << bits | digits << place, place - WIDTH

    def spelled(found) -> Entry:
        if found is None:
            return None
        weight, place = found
        digits = (weight & (1 << bits) - 1) >> (place + WIDTH)
        n = bits // WIDTH - place // WIDTH - 1
        return weight >> bits, "".join(LETTERS[digits >> WIDTH * k & 7] for k in range(n - 1, -1, -1))

    best = [packed(e) for e in entries]
    for initial, fault in rows:
        after = [None] * 4
        for state, found in enumerate(_with_inserts(best, bits)):
            if found is None:
                continue
            weight, place = found
            edits = [("D", DELETE, state)]
            if fault not in (BLANK, DUPLICATE):
                more = UNMENDED if fault == TRUNCATED else 0
                edits.append(("R", REROLE + more, AFTER[state]))
                kept = kept_state(state, initial)
                if kept is not None:
                    edits.append(("K", KEEP + more, kept))
            for letter, cost, to in edits:
                new = (weight + (cost << bits) + (LETTERS.index(letter) << place), place - WIDTH)
                if after[to] is None or new < after[to]:
                    after[to] = new
        best = after
    best = _with_inserts(best, bits)
    if last:
        return (spelled(min(b for b in (best[START], best[ASSISTANT]) if b)),)
    # From ASSISTANT everything can follow that can from START, but for a kept system turn, which it can delete instead.
    if best[ASSISTANT]:
        least = best[ASSISTANT][0] >> bits
        for state, lead in ((START, DELETE), (SYSTEM, 0)):
            if best[state] and best[state][0] >> bits > least + lead:
                best[state] = None
    return tuple(spelled(b) for b in best)


def common_length(texts: list[str]) -> int:
    low, high = min(texts), max(texts)
    n = 0
    while n < min(len(low), len(high)) and low[n] == high[n]:
        n += 1
    return n


class Conversation:
    """The rows of one conversation in order; ``give`` gets each repaired turn as (edit, turn, role, text)."""

    def __init__(self, give: Callable[[str, int | None, str, str], None]):
        self.give = give
        self.counts = [0, 0, 0, 0]
        self.illegal = self.distinct = self.paid = 0
        self.first_turn = self.last_turn = self.before = None
        self.entries: tuple[Entry, ...] = ((0, ""), None, None, None)
        self.rows: list[tuple[str, int]] = []
        self.waiting: list[tuple] = []
        self.state = START
        self.audit: list[str] = []

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1] if role[:1] in ROLES else ""
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.counts[fault] += 1
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.distinct += 1
        self.rows.append((initial, fault))
        # rows that have to go are not kept waiting
        self.waiting.append((turn, role, text) if fault not in (BLANK, DUPLICATE) else None)
        if len(self.rows) >= BLOCK:
            self._settle(False)

    def _settle(self, last: bool) -> None:
        self.entries = scripts(self.entries, tuple(self.rows), last)
        self.rows = []
        live = [e for e in self.entries if e]
        n, least = common_length([letters for _, letters in live]), min(cost for cost, _ in live)
        self.paid += least
        used = 0
        for letter in live[0][1][:n]:
            turn, role, text = None, "", ""
            if letter != "I":
                turn, role, text = self.waiting[used] or (None, "", "")
                used += 1
            if letter == "D":
                continue
            if letter == "K":
                self.state = kept_state(self.state, role[:1])
            else:
                role, self.state = WANTED[self.state], AFTER[self.state]
            self.give(letter, turn, role, text)
        self.audit.append(live[0][1][:n])
        del self.waiting[:used]
        self.entries = tuple(e and (e[0] - least, e[1][n:]) for e in self.entries)

    def end(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost and the audit."""
        self._settle(True)
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.distinct
        return (gaps, *self.counts[1:], self.illegal, self.paid, "".join(self.audit))


def turns(rows: DataFrame, present: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, present of ``rows`` as the operators take them; null roles and texts are one space."""
    kept = F.col(present) if present else F.lit(True)
    return rows.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        kept.alias("present"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults, chosen by the checksum of ``conv_id:turn``.

    A dropped row stays with ``present`` false, so that a conversation that lost all of its rows is still known.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = turns(conversations).withColumn("kind", kind)
    role, text = F.col("role"), F.col("text")
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (F.col("kind") != 0).alias("present"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def _last_mark(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1))


def in_order(rows: DataFrame, present: str | None = None) -> DataFrame:
    """The rows of a conversation one after the other by turn (nulls first), role and text, with their first ``fault``.

    Both orders, of equal rows and of turns, are sorts that spill, after one exchange by ``conv_id``.
    """
    rows = turns(rows, present)
    again = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.asc_nulls_first("turn"))
    end = _last_mark(F.col("text"))
    fault = (
        F.when(end == "", BLANK)
        .when(F.col("nth") > 1, DUPLICATE)
        .when(~end.isin(".", "!", "?"), TRUNCATED)
        .otherwise(0)
    )
    return (
        rows.repartition("conv_id")
        .withColumn("nth", F.row_number().over(again))
        .withColumn("fault", fault)
        .sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "nth")
    )


def _conversations(batches: Iterator[pa.RecordBatch], start: Callable, done: Callable) -> Iterator[None]:
    """Runs the sorted rows through one ``Conversation`` after another; yields at the end of each batch."""
    current, key, any_row = None, None, False
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "present")]
        for conv_id, turn, role, text, fault, present in zip(*columns):
            if not any_row or conv_id != key:
                if any_row:
                    done(key, current)
                current, key, any_row = start(conv_id), conv_id, True
            if present:
                current.add(turn, role, text, fault)
        yield
    if any_row:
        done(key, current)
        yield


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def repair_report(rows: DataFrame, present: str | None = None) -> DataFrame:
    """One row per ``conv_id``, null being one too: gaps, faults, cost, audit letters and the hash of the repaired text.

    ``rows`` has conv_id, turn, role and text; where the column ``present`` is given and false, a row only names its conversation.
    Null roles and texts count as one space, so such a text is blank. Rows of one turn are taken by role and text.
    Equal rows are duplicates of the first of them. Other columns are ignored. A conversation without rows has zeros, an
    empty audit and the hash of the empty string; an empty table gives no rows.

    The hash of a text is made from its start to its end, so the rows of a conversation pass one task in order, a batch
    at a time; what the task holds are undecided tails of scripts and their rows, and the letters that it returns.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        out: list[tuple] = []

        def start(_):
            digest, first = hashlib.sha256(), [True]

            def give(letter, turn, role, text):
                digest.update(f"{'' if first[0] else chr(10)}{role}:{text}".encode())
                first[0] = False

            conversation = Conversation(give)
            conversation.digest = digest
            return conversation

        def done(conv_id, conversation):
            out.append((conv_id, *conversation.end(), conversation.digest.hexdigest()))

        for _ in _conversations(batches, start, done):
            if out:
                columns = list(zip(*out))
                arrays = [pa.array(columns[0], wanted), *[pa.array(c, pa.int64()) for c in columns[1:7]]]
                arrays += [pa.array(c, pa.string()) for c in columns[7:]]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                out.clear()

    names = ["conv_id", *[part.split()[0] for part in REPORT.split(", ")]]
    wanted = _arrow_type(rows, "conv_id")
    return in_order(rows, present).mapInArrow(run, f"conv_id {kind}, {REPORT}")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit, turn (null for inserted ones), role, text."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        out: list[tuple] = []

        def start(conv_id):
            place = [0]

            def give(letter, turn, role, text):
                out.append((conv_id, place[0], letter, turn, role, text))
                place[0] += 1

            return Conversation(give)

        for _ in _conversations(batches, start, lambda _, conversation: conversation.end()):
            if out:
                types = [wanted, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
                arrays = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "place", "edit", "turn", "role", "text"])
                out.clear()

    wanted = _arrow_type(rows, "conv_id")
    return in_order(rows).mapInArrow(run, f"conv_id {kind}, place bigint, edit string, turn bigint, role string, text string")


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)

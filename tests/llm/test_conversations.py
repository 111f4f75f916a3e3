"""Conversation repair against a search over all edit scripts and against SQL."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from riskframe.llm import conversation_repair as repair
from riskframe.llm import queries
from tests import oracle

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
GOAL = re.compile(r"(s?(ua)+)?")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        marks = WORD.findall(text)
        if not marks:
            out.append(repair.BLANK)
        elif (role, text) in seen:
            out.append(repair.DUPLICATE)
        else:
            out.append(0 if marks[-1] in ".!?" else repair.TRUNCATED)
        seen.add((role, text))
    return out


def cheapest(rows):
    """All scripts with at most two inserts at any place, none left out for its cost."""
    marks = faults(rows)
    best = None
    choices = []
    for (_, role, text), fault in zip(rows, marks):
        one = [("D", 4, [])]
        if fault not in (repair.BLANK, repair.DUPLICATE):
            more = 3 if fault == repair.TRUNCATED else 0
            one.append(("K", more, [(role, text)]))
            one += [("R", 3 + more, [(r, text)]) for r in ("user", "assistant")]
        choices.append(one)
    inserts = [()] + [tuple(x) for n in (1, 2) for x in itertools.product(("user", "assistant"), repeat=n)]
    for edits in itertools.product(*choices):
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(e[1] for e in edits) + 3 * sum(map(len, added))
            if best and cost > best[0]:
                continue
            audit, out = "", []
            for i in range(len(rows) + 1):
                audit += "I" * len(added[i])
                out += [(r, "") for r in added[i]]
                if i < len(rows):
                    audit += edits[i][0]
                    out += edits[i][2]
            if GOAL.fullmatch("".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best or (0, "", [])


def expected(rows):
    """The report of (turn, role, text) rows in order."""
    marks = faults(rows)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, out = cheapest(rows)
    text = "\n".join(f"{r}:{t}" for r, t in out)
    counts = [marks.count(k) for k in (1, 2, 3)]
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damage(conv_id, turn, role, text):
    key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
    role, text = " " if role is None else role, " " if text is None else text
    kind = zlib.crc32(key.encode()) % 20
    if kind == 0:
        return []
    if kind == 1:
        text = ""
    if kind == 2:
        text = re.sub("[.!?]", "", text)
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def test_scripts_by_exhaustive_search(spark):
    rng = random.Random(3)
    roles, texts = ["system", "user", "assistant", "tool", "", "s"], ["Yes.", "No", "", " \t", "Why?", "so on "]
    rows, want = [], {}
    for conv_id in range(60):
        mine = [(rng.choice([None, 1, 2, 3, 7]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.choice([1, 2, 3, 3]))]
        want[conv_id] = expected(ordered(mine))
        rows += [(conv_id, *r) for r in mine]
    got = {r[0]: tuple(r[1:]) for r in repair.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def plain(rows):
    """The cheapest script by comparing (cost, letters) as such, over all rows at once."""
    best = {0: (0, "")}

    def inserts(best):
        best = dict(best)
        for _ in range(2):
            for s, (c, a) in list(best.items()):
                to, new = repair.AFTER[s], (c + 3, a + "I")
                best[to] = min(best.get(to, new), new)
        return best

    for (_, role, _), fault in zip(rows, faults(rows)):
        after = {}
        for s, (c, a) in inserts(best).items():
            more = 3 if fault == repair.TRUNCATED else 0
            options = [(s, c + 4, a + "D")]
            if fault not in (repair.BLANK, repair.DUPLICATE):
                options.append((repair.AFTER[s], c + 3 + more, a + "R"))
                kept = repair.kept_state(s, role[:1])
                options += [(kept, c + more, a + "K")] if kept is not None else []
            for to, cost, audit in options:
                after[to] = min(after.get(to, (cost, audit)), (cost, audit))
        best = after
    best = inserts(best)
    return min(best[s] for s in (0, 3) if s in best)


def test_long_conversations_pass_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows, want = [], {}
    for conv_id, n in enumerate((1, 511, 512, 513, 1700)):
        mine = [(t, rng.choice(["user", "assistant", "assistant", "user", "system"]), rng.choice(["", "Yes.", f"Say {t}.", f"cut {t}"])) for t in range(n)]
        want[conv_id] = plain(mine)
        rows += [(conv_id, *r) for r in mine]
    # nothing but blank rows after a first turn that three scripts take differently
    tail = [(0, "assistant", "Go on.")] + [(t, "user", "") for t in range(1, 1500)]
    want[90] = plain(tail)
    rows += [(90, *r) for r in tail]
    rng.shuffle(rows)
    got = repair.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in got} == want


def test_blocks_of_any_size(monkeypatch):
    rng = random.Random(8)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(repair, "BLOCK", size)
        for _ in range(60):
            rows = [(t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["", "Yes.", f"{t}!", f"cut {t}"])) for t in range(rng.randrange(1, 14))]
            out = []
            conversation = repair.Conversation(lambda *turn: out.append(turn))
            for row, fault in zip(rows, faults(rows)):
                conversation.add(*row, fault)
            *_, cost, audit = conversation.end()
            assert (cost, audit) == plain(rows)
            assert GOAL.fullmatch("".join(role[:1] for _, _, role, _ in out))


def test_repaired_turns_are_what_the_report_hashes(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello!"), (1, 2, "user", "Who?"), (2, None, None, None), (None, 5, "user", "Hm?")]
    df = spark.createDataFrame(rows, SCHEMA)
    turns = repair.repaired_turns(df).orderBy("conv_id", "place").collect()
    by_id = {}
    for r in turns:
        by_id.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in repair.repair_report(df).collect():
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(by_id.get(r["conv_id"], [])).encode()).hexdigest()
    assert [(r["edit"], r["role"]) for r in turns if r["conv_id"] == 1] == [
        ("K", "system"), ("I", "user"), ("K", "assistant"), ("K", "user"), ("I", "assistant")
    ]


def test_odd_tables(spark):
    rows = [
        (None, None, None, None), (None, 3, "user", "x" * 200_000 + "."), (4, None, "user", "A."), (4, 1, None, "B."),
        (5, -3, "assistant", None), (6, 2, "user", "Q?"), (6, 2, "user", "Q?"), (6, 2, "assistant", "A."), (7, 9, "USER", "\x85"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("kind", "fault", "present", "cost", "audit", "place", "copy"):
        df = df.withColumn(name, df["role"])
    want = {}
    for conv_id in {r[0] for r in rows}:
        want[conv_id] = expected(ordered([d for r in rows if r[0] == conv_id for d in damage(*r)]))
    got = {r[0]: tuple(r[1:]) for r in repair.repair_report(repair.damaged(df), "present").collect()}
    assert got == want
    assert repair.repair_report(repair.damaged(df.limit(0)), "present").count() == 0
    texts = spark.createDataFrame([("c1", 0, "user", "Hi."), ("c1", 1, "assistant", "Yo.")], "conv_id string, turn int, role string, text string")
    assert [tuple(r)[:8] for r in repair.repair_report(texts).collect()] == [("c1", 0, 0, 0, 0, 0, 0, "KK")]


def test_a_conversation_that_lost_all_rows_is_returned(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = repair.repair_report(repair.damaged(spark.createDataFrame([(lost, 0, "user", "Hi.")], SCHEMA)), "present").first()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_whole_table_against_plain_rules(spark, sf_dir):
    name = next(n for n in queries.QUERIES if n.startswith("op11_"))
    got = {r[0]: tuple(r[1:]) for r in queries.QUERIES[name](spark, sf_dir).collect()}
    rows = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        rows.setdefault(r["conv_id"], []).extend(damage(r["conv_id"], r["turn"], r["role"], r["text"]))
    assert set(got) == set(rows)
    for conv_id, mine in rows.items():
        mine = ordered(mine)
        assert got[conv_id][5:7] == plain(mine)
        if len(mine) <= 3:
            assert got[conv_id] == expected(mine)


def test_sql(spark, sf_dir):
    name = next(n for n in queries.QUERIES if n.startswith("op11_"))
    problems, rows = oracle.compare(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.ORACLES[name])
    assert not problems and rows, problems

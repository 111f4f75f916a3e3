"""Words that differ by one letter, found through grams of variable length, and the commoner form of each.

A word, between a mark at its start and one at its end, has one gram from each place: the shortest one, of ``LEAST_GRAM``
letters or more, that is not frequent in the vocabulary, or the one of ``word_length`` letters. Which gram it is depends on
its own letters alone, so one edit changes only grams over the edited place. The most grams that a single edit can affect
are a bound known for each word: of any that many and one more, two words one edit apart share one at the same place or,
behind an edit that changes the length, at the place next to it. So each word looks up only its rarest grams, as many as
that, and every pair found is verified. As a word has more places than any of its grams has letters, the bound always
leaves at least one gram.

The dictionary of frequent grams has at most ``dictionary`` entries whatever the vocabulary, since a gram is frequent when
it has more than a ``dictionary``-th of all occurrences, and travels with the function that takes words apart.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.tables import written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LEAST_GRAM = 2
START, END = "^", "$"
#: Words of the counts that a task holds before it passes them on.
HELD = 200_000


def runs(text: str) -> list[str]:
    """The letter runs of a text, with A-Z in lower case."""
    return RUN.findall(text.encode().translate(LOWER).decode())


def mangled(doc_id: str, counts: Counter, every: int) -> Iterator[tuple[str, int]]:
    """The runs of one document with one letter deleted where ``every`` divides the checksum of ``doc_id:run``."""
    head = zlib.crc32(f"{doc_id}:".encode())
    for run, n in counts.items():
        check = zlib.crc32(run.encode(), head)
        if check % every == 0:
            place = check % len(run)
            run = run[:place] + run[place + 1 :]
        yield run, n


def word_counts(docs: DataFrame, word_length: int = 6, least: int = 5, every: int | None = 199) -> DataFrame:
    """(word, n): words of ``word_length`` letters or more with ``least`` occurrences or more over all documents.

    ``every`` plants misspellings; None leaves the runs as they are. A null text has no words, a null ``doc_id`` counts
    as empty. Each task adds up what it has seen and passes it on when it holds ``HELD`` words.
    """

    def count(batches):
        def out(held: Counter):
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("id"), batch.column("text")):
                text = text.as_py()
                if not text:
                    continue
                counts = Counter(runs(text))
                for word, n in mangled(doc_id.as_py(), counts, every) if every else counts.items():
                    if len(word) >= word_length:
                        held[word] += n
                if len(held) > HELD:
                    yield out(held)
                    held.clear()
        yield out(held)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    found = rows.mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def gram_counts(words: DataFrame, longest: int) -> DataFrame:
    """(gram, n): occurrences of all grams of ``LEAST_GRAM`` to ``longest`` letters in the marked words."""

    def count(batches):
        for batch in batches:
            held: Counter = Counter()
            for word in batch.column("word").to_pylist():
                marked = START + word + END
                held.update(marked[p : p + q] for q in range(LEAST_GRAM, longest + 1) for p in range(len(marked) - q + 1))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"])

    return words.select("word").mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def gram_dictionary(words: DataFrame, longest: int, dictionary: int) -> dict[str, int]:
    """The frequent grams and their occurrences: those with more than a ``dictionary``-th of all, so fewer than that many."""
    counts = written(gram_counts(words, longest), "grams")
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = counts.where(F.col("n") > max(8, math.ceil(total / dictionary)))
    return {r["gram"]: r["n"] for r in frequent.toLocalIterator()}


def grams(word: str, frequent: dict[str, int], longest: int) -> list[str]:
    """The gram from each place of the marked word."""
    marked = START + word + END
    out = []
    for p in range(len(marked) - LEAST_GRAM + 1):
        q = LEAST_GRAM
        while q < longest and p + q < len(marked) and marked[p : p + q] in frequent:
            q += 1
        out.append(marked[p : p + q])
    return out


def affected(lengths: list[int]) -> int:
    """The most grams that one edit can affect: those over one letter; an insert lies between two letters of its grams.

    Grams from place p of the marked word cover the places p to p + length - 1; marks are never edited.
    """
    cover = np.zeros(len(lengths) + LEAST_GRAM, np.int64)
    for p, n in enumerate(lengths):
        cover[p] += 1
        cover[p + n : p + n + 1] -= 1
    return int(np.cumsum(cover)[1 : len(lengths)].max())


def probes_and_index(words: DataFrame, frequent: dict[str, int], longest: int) -> tuple[DataFrame, DataFrame]:
    """The index (gram, place, size, word, n) of all grams, and the rows (gram, place, size, word, n) to look up.

    A word looks up words of its length at the same place and words shorter by one at the same place or the one before.
    """

    def take_apart(batches):
        for batch in batches:
            rows = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                found = grams(word, frequent, longest)
                least = affected([len(g) for g in found]) + 1
                order = sorted(range(len(found)), key=lambda p: (frequent.get(found[p], 0), -len(found[p]), p))
                rare = set(order[:least])
                rows += [(g, p, len(word), word, n, p in rare) for p, g in enumerate(found)]
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["gram", "place", "size", "word", "n", "rare"]
            )

    parts = written(words.select("word", "n").mapInArrow(take_apart, "gram string, place int, size int, word string, n bigint, rare boolean"), "parts")
    shifts = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(s).alias("s")) for p, s in ((0, 0), (0, -1), (-1, -1))])
    probes = parts.where("rare").select("gram", "place", "size", "word", "n", F.explode(shifts).alias("shift"))
    probes = probes.select(
        "gram",
        (F.col("place") + F.col("shift.p")).alias("place"),
        (F.col("size") + F.col("shift.s")).alias("size"),
        "word",
        "n",
        (F.col("shift.s") == 0).alias("same_size"),
    ).where("place >= 0")
    return probes, parts.drop("rare")


def near_pairs(words: DataFrame, word_length: int = 6, dictionary: int = 200_000) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of words exactly one edit apart, each once."""
    frequent = gram_dictionary(words, word_length, dictionary)
    probes, index = probes_and_index(words, frequent, word_length)
    other = index.select("gram", "place", "size", F.col("word").alias("near"), F.col("n").alias("near_n"))
    # of two words of one length the lesser one looks up the greater; verified where they meet
    met = probes.join(other, ["gram", "place", "size"]).where(
        (~F.col("same_size") | (F.col("word") < F.col("near"))) & (F.levenshtein("word", "near", 1) == 1)
    )
    pairs = written(met.select("word", "n", "near", "near_n").distinct(), "near_pairs")
    return pairs.unionByName(
        pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    )


def forms(words: DataFrame, pairs: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest n, if that is at least ``times`` the word's own."""
    best: Column = F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("near")))
    found = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b"))
    enough = -F.col("b.k") >= times * F.col("n")
    return words.join(found, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("b.near")).alias("form"),
        F.when(enough, -F.col("b.k")).alias("form_n"),
    )


def roots(formed: DataFrame, times: int = 5) -> DataFrame:
    """Adds ``root``: from the word, follow forms to the last.

    Each form has ``times`` the occurrences of the one before, so chains are short, and every round doubles the steps
    taken at once: the number of rounds follows from the largest count.
    """
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    largest = formed.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(largest, times)) + 1)
    for _ in range(math.ceil(math.log2(steps))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = written(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "links")
    return formed.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(
    docs: DataFrame, word_length: int = 6, least: int = 5, times: int = 5, every: int | None = 199, dictionary: int = 200_000
) -> DataFrame:
    """One row per word: word, form, root, n, n_near (0 if none), form_n (null if none).

    Words are counted over all whole texts (null: none; extra columns are ignored; repeated rows count again). Near words
    of equal n are taken in code-point order. Tables without words give no rows.
    """
    words = written(word_counts(docs, word_length, least, every), "words")
    formed = written(forms(words, near_pairs(words, word_length, dictionary), times), "forms")
    return roots(formed, times).select("word", "form", "root", "n", "n_near", "form_n")

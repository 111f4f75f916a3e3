"""Near duplicates: SetSketch registers, bands of registers, joint likelihood, then the Jaccard index of the full sets.

A document's set is its distinct word shingles. Register i of its sketch is ``floor(1 - log_b(x_i))`` for the smallest
of exponentially distributed hashes x_i of its elements, truncated to 0 .. ``LAST``: sketches merge by the maximum of
each register, and the share of equal registers grows with the similarity of two sets.

1. Equal sets (128-bit sums of their hashes) are one class, represented by its smallest document.
2. Representatives that agree in ``ROWS`` consecutive registers share a bucket; there are ``BANDS`` bands. A pair with
   similarity 0.8 misses all of them with probability (1 - 0.8**4)**32 < 5e-8.
3. The hub of a bucket, its document with the most company, is compared with the other members, and what it links
   becomes one component: a group of n near copies costs about n comparisons, not n * n / 2.
4. Members of one bucket that are still in different components get a finer sketch, of the low bytes of ``FINE``
   registers, and are compared in blocks of about ``BLOCK`` sketches; a block pair returns only the pairs that the
   likelihood of the number of equal registers does not rule out. So no link between
   different components is lost, no bucket is capped, no pair is made twice and no group meets in one task.
5. Pairs from 3 and 4 become links when their full sets reach the threshold, and links become components.
6. All documents get the component of their class.

Defined cases: null, empty or blank texts have empty sets, link with nothing and stay; fewer words than a shingle form
one shingle; rows that repeat a ``doc_id`` each get the result of their own text; rows without ``doc_id`` link
with nothing and stay; an empty table gives an empty result. Other columns are never read. Shingles are compared by
64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import hashing
from riskframe.llm.components import components
from riskframe.llm.tables import row_hash, without_rows, written

BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
FINE = 1024
LOG_B = np.log(1.001)
#: The largest register value; x ranges from b (register 0) down to b ** -LAST.
LAST = 60_000
BLOCK = 256
#: A pair is dropped when its best similarity explains the registers e**9 times better than any similarity of 0.8 or more.
UNLIKELY = 9.0
MULTIPLIERS = hashing.mix(np.arange(1, FINE + 1, dtype=np.uint64) * np.uint64(hashing.INVERSE)) | np.uint64(1)


def shingle_sets(words: hashing.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document, one document after the other, and the n + 1 offsets."""
    h = words.hashes(hashing.LOWER)
    counts = words.counts()
    at = hashing.window_starts(words, size)
    doc = words.doc()
    value = hashing.windows(h, size)[at] if len(at) else np.zeros(0, np.uint64)
    owner = doc[at]
    for i in np.flatnonzero((counts > 0) & (counts < size)):  # the whole sequence is one shingle
        part = h[words.first[i] : words.first[i + 1]]
        value = np.append(value, hashing.windows(part, len(part)) ^ np.uint64(len(part)))
        owner = np.append(owner, i)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(len(counts) + 1))


def registers(smallest: np.ndarray) -> np.ndarray:
    """Register values from the smallest 64-bit hashes: uniform, made exponential, on the scale of log b, truncated."""
    x = -np.log1p(-(smallest.astype(np.float64) + 0.5) / 2.0**64)
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / LOG_B), 0, LAST).astype(np.uint16)


def sketches(size: int):
    """Rows (doc_id, row_hash, n_shingles, set_sum, set_mix, sketch) of the documents."""

    def run(batches):
        for batch in hashing.slices(batches):
            value, at = shingle_sets(hashing.split_words(batch.column("text")), size)
            n = np.diff(at)
            full = np.flatnonzero(n)
            begin = at[:-1][full]
            low = np.zeros((len(n), REGISTERS), np.uint64)
            total, mixed = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(full):
                for i, m in enumerate(MULTIPLIERS[:REGISTERS]):
                    low[full, i] = np.minimum.reduceat(value * m, begin)
                total[full] = np.add.reduceat(value, begin)
                mixed[full] = np.add.reduceat(hashing.mix(value), begin)
            rows = registers(low)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_hash"),
                    pa.array(n.astype(np.int64)),
                    pa.array(total.view(np.int64)),
                    pa.array(mixed.view(np.int64)),
                    pa.array([r.tobytes() for r in rows], pa.binary()),
                ],
                names=["doc_id", "row_hash", "n_shingles", "set_sum", "set_mix", "sketch"],
            )

    return run


def fine_sketches(size: int):
    """Rows (id, fine): the low bytes of ``FINE`` registers of non-empty sets."""

    def run(batches):
        for batch in hashing.slices(batches):
            value, at = shingle_sets(hashing.split_words(batch.column("text")), size)
            rows = np.stack([registers(np.minimum.reduceat(value * m, at[:-1])) for m in MULTIPLIERS], axis=1)
            fine = (rows & np.uint16(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in fine], pa.binary())], names=["id", "fine"])

    return run


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """(n, BANDS) bucket keys of (n, REGISTERS) sketches."""
    rows = sketch[:, : BANDS * ROWS].astype(np.uint64)
    key = np.zeros((len(rows), BANDS), np.uint64)
    key += np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(hashing.BASE)
    for k in range(ROWS):
        key = hashing.mix(key ^ rows[:, k::ROWS])
    return key


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def bands(batches):
    """Rows (bucket, id) for the bands of each sketch."""
    for batch in batches:
        if batch.num_rows:
            key = band_keys(unpacked(batch.column("sketch")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), batch.column("id").take(pa.array(np.repeat(np.arange(len(key)), BANDS)))],
                names=["bucket", "id"],
            )


def one_sided(jaccard, n_a, n_b):
    """Probabilities that a register is higher in a, and that it is higher in b."""
    share_a, share_b = n_a / (n_a + n_b), n_b / (n_a + n_b)
    b = np.exp(LOG_B)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (b - 1) / b) / LOG_B
    return p(share_a - share_b * jaccard), p(share_b - share_a * jaccard)


def log_likelihood(jaccard, n_a, n_b, higher, lower, equal):
    """Of similarities, given set sizes and the number of registers in which a is higher, lower or equal."""
    up, down = one_sided(jaccard, n_a, n_b)
    return sum(k * np.log(np.maximum(q, 1e-12)) for k, q in ((higher, up), (lower, down), (equal, 1 - up - down)))


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sketches, given the sizes of their sets, do not rule out the threshold."""
    top = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)  # the similarity that the sizes allow
    keep = top >= threshold - 1e-9
    signs = [(a > b).sum(1), (a < b).sum(1), (a == b).sum(1)]
    value = np.stack([log_likelihood(np.minimum(g, top), n_a, n_b, *signs) for g in GRID])
    enough = np.where((GRID >= threshold - 1e-9)[:, None], value, -np.inf).max(0)
    return keep & (value.max(0) - enough <= UNLIKELY)


def plausible_bytes(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs do not rule out the threshold, given how many of their ``FINE`` low bytes are equal.

    The number is binomial: registers are equal, or differ and have the same low byte. Its likelihood is highest at the
    share that was seen.
    """
    up, down = one_sided(threshold, n_a, n_b)
    least = np.clip(1 - (up + down) * 255 / 256, 1e-9, 1 - 1e-9)
    seen = equal / FINE
    with np.errstate(divide="ignore", invalid="ignore"):
        better = np.where(seen > 0, seen * np.log(seen / least), 0) + np.where(seen < 1, (1 - seen) * np.log((1 - seen) / (1 - least)), 0)
    return (seen >= least) | (FINE * better <= UNLIKELY)


GRID = np.linspace(0.3, 1.0, 36)
PAIRS = "a bigint, b bigint"


def likely(threshold: float):
    """The pairs whose sketches do not rule out the threshold: rows (a, b)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (unpacked(batch.column(c)) for c in ("sketch_a", "sketch_b"))
                n_a, n_b = (batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
                keep = pa.array(plausible(a, b, n_a, n_b, threshold))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return run


def block_pairs(threshold: float):
    """The likely pairs (a, b) of two blocks of a bucket: of different components, and in no earlier band together."""

    def unpack(block):
        fields = [np.array([x[c] for x in block], np.int64) for c in ("id", "label", "n_shingles")]
        sketch = np.frombuffer(b"".join(x["sketch"] for x in block), np.uint16).reshape(-1, REGISTERS)
        return *fields, band_keys(sketch), np.frombuffer(b"".join(x["fine"] for x in block), np.uint8).reshape(-1, FINE)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                (id_a, label_a, n_a, key_a, a), (id_b, label_b, n_b, key_b, b) = unpack(row["minor"]), unpack(row["others"])
                band = int(np.flatnonzero(key_a[0] == np.int64(row["bucket"]).view(np.uint64))[0])
                test = label_a[:, None] != label_b
                test &= 1.0 * np.minimum(n_a[:, None], n_b) >= (threshold - 1e-9) * np.maximum(n_a[:, None], n_b)
                test &= (label_b == row["largest"]) | (id_a[:, None] < id_b)  # two minor members meet twice
                for k in range(band):
                    test &= key_a[:, k, None] != key_b[:, k]
                i, j = np.nonzero(test)
                for at in range(0, len(i), 4096):
                    x, y = i[at : at + 4096], j[at : at + 4096]
                    keep = plausible_bytes((a[x] == b[y]).sum(1), n_a[x].astype(np.float64), n_b[y].astype(np.float64), threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(id_a[x[keep]]), pa.array(id_b[y[keep]])], names=["a", "b"])

    return run


def confirmed(size: int, percent: int):
    """The pairs whose full sets reach the threshold: rows (a, b)."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_sets(hashing.split_words(part.column(c)), size) for c in ("text_a", "text_b")]
                for i in range(part.num_rows):
                    a, b = (value[begin[i] : begin[i + 1]] for value, begin in sets)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep[at + i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return run


def near_links(reps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, label) of the representatives that have a link; reps has id, doc_id, row_hash, n_shingles and sketch."""
    buckets = written(reps.select("id", "sketch").mapInArrow(bands, "bucket bigint, id bigint"), "buckets")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("company")).where("company > 1")
    members = written(buckets.join(shared, "bucket"), "members")
    degree = members.groupBy("id").agg(F.sum("company").alias("degree"))
    met = written(reps.join(degree, "id"), "met")
    texts = docs.join(met.select("id", "doc_id", "row_hash"), ["doc_id", "row_hash"]).dropDuplicates(["id"])
    texts = written(texts.select("id", "text"), "texts")
    met = met.drop("doc_id", "row_hash")

    def linked(pairs: DataFrame) -> DataFrame:
        first, second = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        return written(pairs.join(first, "a").join(second, "b").mapInArrow(confirmed(size, percent), PAIRS), "links")

    ranked = members.join(met.select("id", "degree"), "id")
    hubs = ranked.groupBy("bucket").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("hub"))
    pairs = members.join(hubs, "bucket").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    first, second = (met.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    hopeful = pairs.join(first, "a").join(second, "b").mapInArrow(likely(percent / 100), PAIRS)
    links = linked(written(hopeful, "likely"))
    labels = components(links)

    known = members.select("bucket", "id").join(labels, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label"))
    known = written(known, "labelled")
    sizes = known.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(
        F.max_by("label", F.struct("n", "label")).alias("largest"), F.count("*").alias("labels"), F.sum("n").alias("company")
    )
    still_open = written(known.join(largest.where("labels > 1"), "bucket"), "open")
    fine = texts.join(still_open.select("id").distinct(), "id", "left_semi").mapInArrow(fine_sketches(size), "id bigint, fine binary")
    fine = written(met.select("id", "n_shingles", "sketch").join(fine, "id"), "fine")
    rows = still_open.join(fine, "id")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("company") / BLOCK)))
    member = F.struct("id", "label", "n_shingles", "sketch", "fine")
    blocks = written(
        rows.groupBy("bucket", "block", "largest").agg(
            F.collect_list(member).alias("others"), F.collect_list(F.when(F.col("label") != F.col("largest"), member)).alias("minor")
        ),
        "blocks",
    )
    minor = blocks.where(F.size("minor") > 0).select("bucket", "minor")
    met_blocks = blocks.select("bucket", "largest", "others").join(minor, "bucket")
    more = linked(written(met_blocks.mapInArrow(block_pairs(percent / 100), PAIRS), "likely"))
    return components(links.union(more))


def verdicts(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row per document: doc_id, row_hash, n_shingles, class_id, component_id, kept."""
    rows = docs.select(F.col("doc_id").cast("bigint"), row_hash(F.col("text")).alias("row_hash"), "text")
    all_rows = rows.mapInArrow(
        sketches(size), "doc_id bigint, row_hash bigint, n_shingles bigint, set_sum bigint, set_mix bigint, sketch binary"
    )
    all_rows = written(all_rows, "sketches")
    key = ["set_sum", "set_mix", "n_shingles"]
    filled = all_rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # a document's texts may differ: the first set that it represents has its id, any other one an id of its own
    classes = filled.groupBy(*key).agg(F.min(F.struct("doc_id", "row_hash")).alias("first"))
    classes = written(classes.select(*key, F.col("first.doc_id").alias("class_id"), F.col("first.row_hash").alias("row_hash")), "classes")
    firsts = classes.groupBy("class_id").agg(F.min("row_hash").alias("first_hash"))
    own_id = F.when(F.col("row_hash") == F.col("first_hash"), F.col("class_id")).otherwise(F.xxhash64("class_id", *key))
    classes = written(classes.join(firsts, "class_id").select(*key, "class_id", "row_hash", own_id.alias("id")), "classes")
    known = classes.select("id", F.col("class_id").alias("doc_id"), "row_hash")
    reps = filled.join(known, ["doc_id", "row_hash"]).dropDuplicates(["id"])
    reps = written(reps.select("id", "doc_id", "row_hash", "n_shingles", "sketch"), "reps")
    labels = near_links(reps, rows, size, percent)
    labelled = classes.select("id", "class_id").join(labels, "id")
    smallest = labelled.groupBy("label").agg(F.min("class_id").alias("component_id"))
    component = classes.drop("row_hash").join(labels, "id", "left").join(smallest, "label", "left").select(
        *key, "class_id", F.coalesce("component_id", "class_id").alias("component_id")
    )
    own = F.when(F.col("doc_id").isNotNull(), F.col("class_id"))
    found = all_rows.drop("sketch").join(component, key, "left").withColumns(
        {"class_id": F.coalesce(own, "doc_id"), "component_id": F.coalesce(F.when(own.isNotNull(), F.col("component_id")), "doc_id")}
    )
    return found.select(
        "doc_id", "row_hash", "n_shingles", "class_id", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept")
    )


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id, kept."""
    return verdicts(docs, size, percent).drop("row_hash")


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each component, with the columns they came with."""
    return without_rows(docs, verdicts(docs, size, percent).where("not kept"))

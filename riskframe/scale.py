"""Building blocks that keep their cost spread over the cluster when keys are skewed.

Each avoids one of the plans that end in a single task: an unpartitioned
window, a window over a key that holds a large share of the rows, or an
aggregate whose buffer grows with its group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import materialise


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that lambdas below read many times.

    The optimiser merges neighbouring projections, which would copy the
    expression into the lambda and evaluate it per element; it does not merge
    through a generator.
    """
    return df.withColumn(name, F.explode(F.array(value)))


# Buckets per factor e of magnitude. The bucket of a value never depends on the
# data, so a retried task puts a row where its first attempt put it.
BUCKETS_PER_E = 256.0


def monotone_bucket(value: Column) -> Column:
    """A bucket number that never decreases as ``value`` grows.

    The number of buckets is bounded by the range of a double (under 400 000),
    whatever the number of rows.
    """
    x = value.cast("double")
    return F.floor(F.signum(x) * F.log1p(F.abs(x) * F.lit(1e9)) * F.lit(BUCKETS_PER_E))


def in_ranges(df: DataFrame, order: Sequence[str], out: str = "_cell") -> DataFrame:
    """``df`` as a written table with the number of the range of ``order`` that a row belongs to.

    Ranges come from a sample of the rows themselves, so they are even however
    close together the values lie. They differ from run to run, which is why
    the rows are written together with them before anything counts on them.
    """
    ranged = df.repartitionByRange(*order).withColumn(out, F.spark_partition_id())
    return materialise(ranged, "ranges")


def value_ranks(df: DataFrame, value: str, group: Sequence[str] = (), ranged: bool = False) -> DataFrame:
    """One row per distinct value: ``cnt`` rows, ``n_less`` rows below it, ``n`` rows in its group.

    Ties collapse before the shuffle; a group is then split into cells that are
    ordered independently, and cell totals (few rows) give the offset of each
    cell. A cell is a bucket of magnitudes that differ by less than half a
    percent, or, with ``ranged``, an even range of the distinct values, for
    values that may all lie close together; that costs a written table.
    """
    group = list(group)
    vals = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("cnt"))
    if ranged:
        vals = in_ranges(vals, [*group, value])
    else:
        vals = vals.withColumn("_cell", monotone_bucket(F.col(value)))
    over_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = over_group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    offsets = (
        vals.groupBy(*group, "_cell")
        .agg(F.sum("cnt").alias("_bn"))
        .withColumn("n", F.sum("_bn").over(over_group))
        .withColumn("_off", F.sum("_bn").over(before) - F.col("_bn"))
        .drop("_bn")
    )
    inside = Window.partitionBy(*group, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        vals.withColumn("_in", F.sum("cnt").over(inside) - F.col("cnt"))
        .join(offsets, [*group, "_cell"])
        .select(*group, value, "cnt", (F.col("_off") + F.col("_in")).alias("n_less"), "n")
    )


def rank_column(
    df: DataFrame,
    value: str,
    out: str,
    group: Sequence[str] = (),
    method: str = "min",
    descending: bool = False,
    pct: bool = False,
) -> DataFrame:
    """Add the rank of ``value`` over the whole frame or per group; null stays null.

    ``method`` is ``min`` (competition rank) or ``average`` (mean rank of ties).
    """
    ranks = value_ranks(df, value, group)
    below = F.col("n") - F.col("n_less") - F.col("cnt") if descending else F.col("n_less")
    if method == "min":
        rank = below + F.lit(1)
    elif method == "average":
        rank = below.cast("double") + (F.col("cnt").cast("double") + F.lit(1.0)) / F.lit(2.0)
    else:
        raise ValueError(f"unknown rank method {method!r}")
    if pct:
        rank = rank.cast("double") / F.col("n").cast("double")
    return df.join(ranks.select(*group, value, rank.alias(out)), [*group, value], "left")


def exact_quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], group: Sequence[str] = (), ranged: bool = False
) -> DataFrame:
    """Exact linearly interpolated quantiles, one column per entry of ``probs``.

    Reads the wanted order statistics off :func:`value_ranks`; no buffer holds
    the distinct values of a group.
    """
    ranks = value_ranks(df, value, group, ranged)
    aggs = [F.max("n").alias("_n")]
    for name, q in probs.items():
        place = (F.col("n") - F.lit(1)).cast("double") * F.lit(float(q))
        held = F.col(value).cast("double")
        aggs += [
            F.max(F.when(F.col("n_less") <= F.floor(place), held)).alias(f"_{name}_lo"),
            F.max(F.when(F.col("n_less") <= F.ceil(place), held)).alias(f"_{name}_hi"),
        ]
    out = ranks.groupBy(*group).agg(*aggs)
    cols = []
    for name, q in probs.items():
        place = (F.col("_n") - F.lit(1)).cast("double") * F.lit(float(q))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return out.select(*group, *cols)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], first: bool = False) -> DataFrame:
    """The whole last (or first) row per key.

    An aggregate rather than ``row_number``: each map task reduces a key to one
    row before the shuffle, so a key with a third of the rows costs no more.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    pick = F.min if first else F.max
    packed = df.groupBy(*keys).agg(pick(F.struct(*order, *rest)).alias("_row"))
    return packed.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in [*order, *rest]]).select(
        *df.columns
    )


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rn") -> DataFrame:
    """The first ``k`` rows per key in ``order``.

    A filter on ``row_number`` directly above its window becomes a group limit
    that also runs before the shuffle, so each map task sends at most ``k`` rows per key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def previous_value(
    df: DataFrame, key: Sequence[str], chunk: Column, order: Sequence[str], cols: Mapping[str, str]
) -> DataFrame:
    """``lag(1)`` per key for histories of any length.

    The history of a key is cut into chunks (for example its days). A chunk's
    first row takes its value from the last row of the chunk before it, found
    in a table with one row per key and chunk.
    """
    key = list(key)
    rows = df.withColumn("_chunk", chunk)
    ends = rows.groupBy(*key, "_chunk").agg(
        F.max(F.struct(*order, *cols)).alias("_end")
    )
    w_key = Window.partitionBy(*key).orderBy("_chunk")
    carried = ends.select(*key, "_chunk", F.lag("_end").over(w_key).alias("_prev_end"))
    w = Window.partitionBy(*key, "_chunk").orderBy(*order)
    rows = rows.withColumn("_rn", F.row_number().over(w))
    for src, out in cols.items():
        rows = rows.withColumn(f"_in_{out}", F.lag(src).over(w))
    joined = rows.join(carried, [*key, "_chunk"])
    for src, out in cols.items():
        joined = joined.withColumn(
            out, F.when(F.col("_rn") == 1, F.col(f"_prev_end.{src}")).otherwise(F.col(f"_in_{out}"))
        )
    return joined.select(*df.columns, *cols.values())


def prefix_sum(
    df: DataFrame, key: Sequence[str], chunk: Column, order: Sequence[str], sums: Mapping[str, str]
) -> DataFrame:
    """Running sums per key (``value: out``) for histories of any length.

    Sums run inside chunks of a key's history; the totals of the chunks before
    are added from a table with one row per key and chunk. ``chunk`` must not
    decrease along ``order``.
    """
    key = list(key)
    rows = df.withColumn("_chunk", chunk)
    before = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*key, "_chunk").agg(*[F.sum(v).alias(f"_t_{o}") for v, o in sums.items()])
    offsets = totals.select(
        *key, "_chunk", *[F.sum(f"_t_{o}").over(before).alias(f"_o_{o}") for o in sums.values()]
    )
    w = Window.partitionBy(*key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({f"_i_{o}": F.sum(v).over(w) for v, o in sums.items()})
    joined = inside.join(offsets, [*key, "_chunk"])
    made = [
        (F.col(f"_i_{o}") + F.coalesce(F.col(f"_o_{o}"), F.lit(0))).alias(o) for o in sums.values()
    ]
    return joined.select(*df.columns, *made)

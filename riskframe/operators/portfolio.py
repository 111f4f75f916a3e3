"""Holdings from transaction ledgers, their valuation and default symbol sets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.scale import prefix_sum
from riskframe.session import materialise

KEY = ["user_id", "symbol"]
ORDER = ["date", "ord", "price", "quantity"]
QTY = "decimal(38,6)"


def is_valid() -> Column:
    return (F.col("quantity") > 0) & (F.col("price") > 0)


def chunk() -> Column:
    """An order-preserving piece of a ledger of at most a million order numbers."""
    return F.struct(F.col("date").alias("d"), F.floor(F.col("ord") / 1_000_000).alias("o"))


def signed_quantity() -> Column:
    """Exact, so that a full sale leaves exactly nothing."""
    return F.when(F.col("action") == "BUY", F.col("quantity")).otherwise(-F.col("quantity")).cast(QTY)


def share_kept() -> Column:
    """Log of the share of the position a sale leaves; 0 for a buy."""
    before = F.nullif(F.col("_before"), F.lit(0)).cast("double")
    return F.when(F.col("action") == "SELL", F.ln(F.col("held").cast("double") / before)).otherwise(F.lit(0.0))


def cost_today() -> Column:
    """Cost of a buy times the shares of the position kept since."""
    cost = F.when(F.col("action") == "BUY", F.col("quantity") * F.col("price"))
    return F.sum(cost * F.exp(F.col("_total") - F.col("_scale")))


def mark_ledgers(tx: DataFrame) -> DataFrame:
    """Quantity held after each transaction if every sale were accepted, and the ledger's lowest.

    One exchange by ledger, of the transactions as they are; what folds or
    replays the marked rows keeps its partitioning and reads it again.
    """
    ledger = Window.partitionBy(*KEY)
    so_far = ledger.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = by_ledger(tx).withColumn("_signed", signed_quantity()).withColumn("held", F.sum("_signed").over(so_far))
    return rows.withColumn("_low", F.min("held").over(ledger))


def fold_windows(rows: DataFrame) -> DataFrame:
    """Holdings of marked ledgers in which every sale is covered; see :func:`fold_sound`."""
    ledger = Window.partitionBy(*KEY)
    so_far = ledger.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*ORDER)
    rows = rows.withColumn("_before", F.col("held") - F.col("_signed"))
    opens = (F.col("action") == "BUY") & (F.col("_before") == 0)
    rows = rows.withColumns(
        {
            "_open": F.max(F.when(opens, place)).over(ledger),
            "_final": F.max(F.struct(*ORDER, "held")).over(ledger)["held"],
        }
    )
    live = rows.where((F.col("_final") > 0) & (place >= F.col("_open"))).withColumn("_kept", share_kept())
    live = live.withColumns({"_scale": F.sum("_kept").over(so_far), "_total": F.sum("_kept").over(ledger)})
    held = live.groupBy(*KEY).agg(
        F.max("_final").cast("double").alias("quantity"), cost_today().alias("_cost"), F.min("date").alias("opened")
    )
    return held.select(*KEY, "quantity", (F.col("_cost") / F.col("quantity")).alias("avg_price"), "opened")


def running_quantity(tx: DataFrame) -> DataFrame:
    """:func:`mark_ledgers` without its lowest quantity, for ledgers of any length."""
    rows = tx.where(is_valid()).withColumn("_signed", signed_quantity())
    return prefix_sum(rows, KEY, chunk(), ORDER, {"_signed": "held"})


def by_ledger(rows: DataFrame) -> DataFrame:
    return rows.repartition(*[F.col(k) for k in KEY])


#: Ledgers share this many counters when the large ones are looked for.
COUNTERS = 2**16


def crowded_counters(rows: DataFrame, hot_rows: int) -> DataFrame:
    """One row: for each counter, whether the ledgers that share it have more than ``hot_rows`` rows in all."""
    counts = rows.groupBy(counter().alias("c")).agg(F.count(F.lit(1)).alias("n"))
    every = counts.unionByName(rows.sparkSession.range(COUNTERS).select(F.col("id").cast("int").alias("c"), F.lit(0).cast("bigint").alias("n")))
    sums = every.groupBy("c").agg((F.sum("n") > hot_rows).alias("crowded"))
    in_order = F.array_sort(F.collect_list(F.struct("c", "crowded")))
    return sums.agg(F.transform(in_order, lambda x: x["crowded"]).alias("crowded"))


def counter() -> Column:
    return F.pmod(F.hash(*KEY), F.lit(COUNTERS))


def split_by_size(valid: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Valid, written transactions of usual ledgers and of those with more than ``hot_rows`` rows.

    A hash of the ledger is counted first, which leaves few rows per map task.
    Only the ledgers of a counter above ``hot_rows`` are counted one by one and
    compared with the large ones, so the others are not moved for that.
    """
    flags = materialise(crowded_counters(valid, hot_rows), "crowded_counters")
    is_crowded = F.get(flags.scalar(), counter())
    crowded = materialise(valid.where(is_crowded), "crowded_ledgers")
    hot = crowded.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*KEY)
    usual = valid.where(~is_crowded).unionByName(crowded.join(hot, KEY, "left_anti"))
    return usual, crowded.join(hot, KEY, "left_semi")


def split_ledgers(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transactions of ledgers without and with an oversold position."""
    rows = materialise(running_quantity(tx), "hot_ledgers")
    low = rows.groupBy(*KEY).agg(F.min("held").alias("_low"))
    marked = rows.join(low, KEY)
    return marked.where("_low >= 0").drop("_low"), marked.where("_low < 0").drop("_low")


def fold_sound(rows: DataFrame) -> DataFrame:
    """Holdings of ledgers in which every sale is covered.

    A buy adds its cost, a sale scales the cost by the share kept, and a full
    sale starts afresh. So the cost is the sum over the buys since the last
    fresh start of cost times the shares kept afterwards, and that product is
    the exponential of a difference of running sums. No ledger is folded row
    by row, so one account may hold any share of the transactions.
    """
    before = F.col("held") - F.col("_signed")
    rows = rows.withColumn("_before", before)
    opens = (F.col("action") == "BUY") & (F.col("_before") == 0)
    place = F.struct(*ORDER)
    ends = rows.groupBy(*KEY).agg(
        F.max(F.when(opens, place)).alias("_open"),
        F.max(F.struct(*ORDER, "held"))["held"].alias("_final"),
    )
    live = rows.join(ends.where("_final > 0"), KEY).where(place >= F.col("_open"))
    live = prefix_sum(live.withColumn("_kept", share_kept()), KEY, chunk(), ORDER, {"_kept": "_scale"})
    total = live.groupBy(*KEY).agg(F.sum("_kept").alias("_total"))
    return (
        live.join(total, KEY)
        .groupBy(*KEY)
        .agg(
            F.max("_final").cast("double").alias("quantity"),
            cost_today().alias("_cost"),
            F.min("date").alias("opened"),
        )
        .select(*KEY, "quantity", (F.col("_cost") / F.col("quantity")).alias("avg_price"), "opened")
    )


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replay sorted ledgers, holding one account's state at a time.

    Yields rejected sales (kind 'oversold') and each account's final holding.
    """
    account, held, price, opened = None, 0.0, 0.0, None

    def closing():
        return (*account, "holding", opened, None, held, price) if account is not None and held > 0 else None

    for g in batches:
        out = []
        columns = (g["user_id"], g["symbol"], g["date"], g["ord"], g["action"], g["quantity"], g["price"])
        for user, symbol, day, ord_, action, qty, px in zip(*columns):
            if (user, symbol) != account:
                done = closing()
                if done:
                    out.append(done)
                account, held, price, opened = (user, symbol), 0.0, 0.0, None
            if action == "BUY":
                if held == 0:
                    price, opened = px, day
                else:
                    price = (held * price + qty * px) / (held + qty)
                held = round(held + qty, 6)
            elif qty > held:
                out.append((user, symbol, "oversold", day, ord_, qty, px))
            else:
                held = round(held - qty, 6)
        yield pd.DataFrame(out, columns=["user_id", "symbol", "kind", "date", "ord", "quantity", "price"])
    done = closing()
    if done:
        yield pd.DataFrame([done], columns=["user_id", "symbol", "kind", "date", "ord", "quantity", "price"])


def replay(rows: DataFrame) -> DataFrame:
    """Ledgers replayed in order; each must lie whole in one partition.

    Which sale is rejected depends on every row before it. The rows are sorted
    by Spark (spilling as needed) and streamed through with the state of one
    account in memory; no ledger is gathered.
    """
    ordered = rows.select(*KEY, "date", "ord", "action", "quantity", "price").sortWithinPartitions(*KEY, *ORDER)
    types = dict(ordered.dtypes)
    return ordered.mapInPandas(
        _walk,
        f"user_id {types['user_id']}, symbol string, kind string, date date, ord bigint, quantity double, price double",
    )


def replay_refusing(marked: DataFrame, oversold: DataFrame) -> DataFrame:
    """Replay of the marked usual ledgers that sell too much, where they lie, and of such hot ledgers."""
    return replay(marked.where("_low < 0")).unionByName(replay(by_ledger(oversold)))


HOT_ROWS = 1_000_000


def holdings_from_transactions(tx: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Open holdings (user_id, symbol, quantity, avg_price, opened).

    A ledger in which every sale is covered folds into sums: by windows when it
    has a usual size, by chunked running sums when it is so large that one task
    should not hold it. Only ledgers with refused sales are replayed. The
    transactions are written once, as several steps read them, and moved to
    their ledgers once.
    """
    usual, hot = split_by_size(materialise(tx.where(is_valid()), "transactions"), hot_rows)
    marked = mark_ledgers(usual)
    sound, oversold = split_ledgers(hot)
    replayed = replay_refusing(marked, oversold).where("kind = 'holding'")
    folded = fold_windows(marked.where("_low >= 0")).unionByName(fold_sound(sound))
    return folded.unionByName(
        replayed.select(*KEY, "quantity", F.col("price").alias("avg_price"), F.col("date").alias("opened"))
    )


def rejected_transactions(tx: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Transactions the ledger refuses: non-positive quantity or price, or a sale beyond the holding."""
    tx = materialise(tx, "transactions")
    bad = tx.where(~is_valid()).select(
        *KEY, "date", "ord", "quantity", "price",
        F.when(F.col("quantity") <= 0, "quantity must be positive").otherwise("price must be positive").alias("reason"),
    )
    usual, hot = split_by_size(tx.where(is_valid()), hot_rows)
    _, oversold = split_ledgers(hot)
    refused = replay_refusing(mark_ledgers(usual), oversold).where("kind = 'oversold'")
    return bad.unionByName(
        refused.select(*KEY, "date", "ord", "quantity", "price", F.lit("sale exceeds holding").alias("reason"))
    )


def rounded_valuation(valued: DataFrame) -> DataFrame:
    money = ["current_price", "current_value", "cost_basis", "gain_loss", "gain_loss_pct"]
    return valued.withColumns({c: F.round(c, 2) for c in money})


def portfolio_summary(valued: DataFrame) -> DataFrame:
    """Totals per user."""
    totals = valued.groupBy("user_id").agg(
        F.sum("current_value").alias("total_value"),
        F.sum("cost_basis").alias("total_cost"),
        F.count(F.lit(1)).alias("holdings_count"),
    )
    gain = F.col("total_value") - F.col("total_cost")
    return totals.withColumn("total_gain_loss", gain).withColumn(
        "total_gain_loss_pct",
        F.when(F.col("total_cost") > 0, F.col("total_gain_loss") / F.col("total_cost") * 100).otherwise(0.0),
    )


def default_symbols(users: DataFrame, requested: DataFrame, holdings: DataFrame, stocks: DataFrame, k: int = 10) -> DataFrame:
    """Symbols to analyse per user: those requested, else those held, else the first active stocks.

    Requested and held symbols are written, as they are read twice, so holdings are computed once.
    """
    asked = requested.select("user_id", "symbol").distinct()
    held = holdings.select("user_id", "symbol").distinct().join(asked.select("user_id").distinct(), "user_id", "left_anti")
    chosen = materialise(asked.unionByName(held), "chosen_symbols")
    first = stocks.where("is_active").select("symbol").orderBy("symbol").limit(k)
    fallback = first.agg(F.array_sort(F.collect_list("symbol")).alias("s"))
    rest = (
        users.select("user_id")
        .join(chosen.select("user_id").distinct(), "user_id", "left_anti")
        .withColumn("symbol", F.explode(fallback.scalar()))
    )
    return chosen.unionByName(rest)

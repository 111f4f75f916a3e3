"""Query catalogue and the SQL fragments shared by the comparison queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its equivalent SQL if there is one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def cte(name: str, text: str, *needs: str, columns: str = "", materialised: bool = False) -> None:
    head = f"{name}({columns})" if columns else name
    _CTES[name] = (needs, f"{head} AS {'MATERIALIZED ' if materialised else ''}({text})")


def using(names: str, body: str) -> str:
    """``body`` preceded by the named common table expressions and what they need."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for need in _CTES[n][0]:
            visit(need)
        order.append(n)

    for n in names.split():
        visit(n)
    ctes = ",\n".join(_CTES[n][1] for n in order)
    return f"WITH RECURSIVE {ctes}\n{body.strip()}"


# Values are compared by hash, so both sides round. The offset keeps values
# that end in an exact 5 off the rounding boundary, where the engines differ.
def rnd(col: Column | str, digits: int = 6) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double") + F.lit(1e-9), digits) + F.lit(0.0)


def sql_rnd(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE) + CAST(1e-9 AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column for comparison."""
    return df.select(
        *[
            rnd(f.name, digits).alias(f.name)
            if f.dataType.typeName() == "double" and f.name not in skip
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def sql_cols(spec: str, digits: int = 6) -> str:
    """``a, b=expr`` -> rounded select items."""
    items = []
    for part in spec.split(";"):
        part = part.strip()
        if not part:
            continue
        name, _, expr = part.partition("=")
        name = name.strip()
        items.append(f"{sql_rnd(expr.strip() or name, digits)} AS {name}")
    return ", ".join(items)


# ---- shared tables -------------------------------------------------------

cte(
    "px",
    """SELECT p.p_brand AS symbol, CAST(l.l_shipdate AS DATE) AS date,
              l.l_extendedprice / l.l_quantity AS px, l.l_quantity AS qty,
              l.l_orderkey * 10 + l.l_linenumber AS ord
       FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
       WHERE l.l_quantity > 0""",
)
cte(
    "bars",
    """SELECT symbol, date, first(px ORDER BY ord, px) AS open, max(px) AS high, min(px) AS low,
              last(px ORDER BY ord, px) AS close, CAST(sum(qty) AS BIGINT) AS volume
       FROM px GROUP BY symbol, date""",
    "px",
)
cte(
    "wbars",
    """SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS date, first(open ORDER BY date) AS open,
              max(high) AS high, min(low) AS low, last(close ORDER BY date) AS close,
              CAST(sum(volume) AS BIGINT) AS volume
       FROM bars GROUP BY 1, 2""",
    "bars",
)
cte(
    "bench",
    """SELECT date, avg(close) AS close, CAST(sum(volume) AS BIGINT) AS volume
       FROM (SELECT * FROM bars ORDER BY date, symbol) GROUP BY date""",
    "bars",
)
cte("ret", "SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM bars", "bars")
cte("wret", "SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM wbars", "wbars")
cte(
    "stocks",
    """SELECT DISTINCT p_brand AS symbol, p_brand AS name,
              'S' || CAST(CAST(split_part(p_brand, '#', 2) AS BIGINT) % 5 AS VARCHAR) AS sector,
              CAST(split_part(p_brand, '#', 2) AS BIGINT) % 7 <> 0 AS is_active
       FROM part""",
)
cte(
    "history",
    """SELECT event_id, CAST(user_id AS VARCHAR) AS symbol, ts, CAST(ts AS DATE) AS date,
              least(value / 100, CAST(1 AS DOUBLE)) AS risk_score,
              CASE WHEN least(value / 100, CAST(1 AS DOUBLE)) > CAST(0.6 AS DOUBLE) THEN 'High'
                   WHEN least(value / 100, CAST(1 AS DOUBLE)) > CAST(0.3 AS DOUBLE) THEN 'Medium' ELSE 'Low' END AS risk_level
       FROM events""",
)
cte(
    "scores",
    """SELECT symbol, max(date) AS date, last(ts ORDER BY ts, event_id) AS ts,
              last(risk_score ORDER BY ts, event_id) AS risk_score,
              last(risk_level ORDER BY ts, event_id) AS risk_level
       FROM history GROUP BY symbol""",
    "history",
)
cte(
    "news",
    """SELECT doc_id, 'Brand#' || CAST(doc_id % 25 + 1 AS VARCHAR) AS symbol, source,
              substr(split_part(text, chr(10), 1), 1, 150) AS headline, text AS content,
              substr(text, 1, 500) AS description,
              source || '/' || CAST(doc_id AS VARCHAR) AS url,
              CAST(DATE '2001-11-04' - CAST(doc_id % 30 AS INTEGER) AS DATE) AS published
       FROM documents""",
)

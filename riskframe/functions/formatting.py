"""Display columns: percent strings, driver strings, humanised volumes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.functions.numeric import as_col


# Added before formatting so that a decimal half rounds up on every platform.
HALF = 1e-9


def fixed(value: Column | str, digits: int = 2) -> Column:
    """``0.1234`` -> ``0.12``, null -> ``N/A``."""
    shown = F.format_string(f"%.{digits}f", as_col(value) + F.lit(HALF))
    return F.when(as_col(value).isNull(), "N/A").otherwise(shown)


def percent(value: Column | str, digits: int = 2) -> Column:
    """``0.1234`` -> ``12.34%``, null -> ``N/A``."""
    shown = F.format_string(f"%.{digits}f%%", as_col(value) * 100 + F.lit(HALF))
    return F.when(as_col(value).isNull(), "N/A").otherwise(shown)


def polarity(value: Column | str) -> Column:
    v = as_col(value)
    return F.when(v > 0, "Positive").when(v < 0, "Negative").otherwise("Neutral")


def humanise_volume(value: Column | str) -> Column:
    v = as_col(value).cast("double")
    return (
        F.when(v.isNull(), "")
        .when(v >= 1e9, F.format_string("%.1fB", v / 1e9 + HALF))
        .when(v >= 1e6, F.format_string("%.1fM", v / 1e6 + HALF))
        .when(v >= 1e3, F.format_string("%.1fK", v / 1e3 + HALF))
        .otherwise(as_col(value).cast("bigint").cast("string"))
    )


def driver_flags(vol: Column, drawdown: Column, sentiment: Column, liquidity: Column) -> Column:
    """Names of the components above their thresholds, joined by ' | '."""
    hits = F.concat_ws(
        " | ",
        F.when(vol > 0.7, "High volatility"),
        F.when(drawdown > 0.7, "Significant drawdown"),
        F.when(sentiment > 0.6, "Negative news sentiment"),
        F.when(liquidity > 0.6, "Liquidity concerns"),
    )
    return F.coalesce(F.nullif(hits, F.lit("")), F.lit("Stable metrics"))


def signed_list(pairs: Column, plus: bool) -> Column:
    """``array<struct(name, value)>`` -> ``a (+0.123), b (+0.045)``, ``none`` when empty."""
    pattern = "%s (+%.3f)" if plus else "%s (%.3f)"
    text = F.array_join(F.transform(pairs, lambda p: F.format_string(pattern, p["name"], p["value"] + HALF)), ", ")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("none"))


def up_down_drivers(up: Column | str, down: Column | str) -> Column:
    return F.concat(F.lit("↑ "), as_col(up), F.lit(" | ↓ "), as_col(down))

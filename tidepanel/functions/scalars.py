"""Scalar functions of codes, dates, fees and text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price limit of a board by the leading digits of its codes; 1.0 (funds) is no limit, other codes have 10 %.
LIMIT_RATIOS = {"5": 1.0, "15": 1.0, "16": 1.0, "18": 1.0, "300": 0.20, "301": 0.20, "688": 0.20, "689": 0.20, "8": 0.30, "4": 0.30, "920": 0.30}
# Redemption fee by days held; none from 365 days on.
REDEMPTION_TIERS = ((7, 0.015), (30, 0.0075), (365, 0.005))


def zero_filled(c: Column, width: int = 6) -> Column:
    """A code filled with zeros to `width`; longer codes stay whole."""
    text = c.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def limit_ratio(code: Column) -> Column:
    """The daily price limit of a code's board."""
    out = F.lit(0.10)
    for prefix, value in reversed(LIMIT_RATIOS.items()):
        out = F.when(code.startswith(prefix), F.lit(value)).otherwise(out)
    return out


def market_suffix(code: Column) -> Column:
    """The market of a six-digit code."""
    return F.concat(code, F.when(code.rlike("^(5|6|9)"), F.lit(".SH")).when(code.rlike("^(4|8)"), F.lit(".BJ")).otherwise(F.lit(".SZ")))


def redemption_rate(days: Column, tiers=REDEMPTION_TIERS) -> Column:
    """The fee rate of fund shares held so many days."""
    out = F.lit(0.0)
    for below, rate in reversed(tiers):
        out = F.when(days < below, F.lit(rate)).otherwise(out)
    return out


def fee(amount: Column, rate: float, least: float = 0.0) -> Column:
    return F.greatest(amount * F.lit(rate), F.lit(least))


def lots(shares: Column, lot: int) -> Column:
    """Shares rounded down to whole lots."""
    return F.floor(shares / lot) * lot


def percent(text: Column) -> Column:
    """`1.50%` as 0.015; null for other text."""
    return F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*%\s*$", 1).try_cast("double") / 100


def number(text: Column) -> Column:
    """A number, or null where the text isn't one."""
    return F.trim(text).try_cast("double")


def filled(text: Column, other: str = "") -> Column:
    """The text, or `other` where it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(other))


def json_field(text: Column, name: str) -> Column:
    return F.get_json_object(text, f"$.{name}")


def list_text(values: Column, most: int = 12) -> Column:
    """At most so many elements, joined by commas."""
    return F.array_join(F.slice(values, 1, most), ",")


def row_digest(*columns: Column) -> Column:
    """SHA-256 of a row's values as text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)


def round_half_away(c: Column, digits: int) -> Column:
    """c scaled, rounded half away from zero and scaled back, all in doubles, as SQL engines without decimals in round() do."""
    scale = F.lit(10.0**digits)
    x = F.abs(c) * scale
    whole = F.floor(F.when(x < 2.0**52, x)).cast("double")  # from there on, doubles are whole numbers
    return F.signum(c) * F.coalesce(whole + F.when(x - whole >= 0.5, 1.0).otherwise(0.0), x) / scale + 0.0


def finite(c: Column) -> Column:
    """Null for NaN and infinities, which sort and sum badly."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)

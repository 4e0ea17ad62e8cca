"""Numeric helpers shared by every job.

All builders in ``roadwise.functions`` take SQL expressions (column names or expression
text) and return Spark SQL expression text; ``E`` turns text into a Column. Building a
whole expression as text costs one call into the JVM, while composing it from Column
operators costs one call per operator.

Rounding is written as ``floor(x * 10^k + 0.5) / 10^k`` rather than Spark's decimal-string
HALF_UP ``round``. Both agree except on exact decimal ties, and this form is plain IEEE
arithmetic, so it gives the same bits in any SQL engine; that is what lets results be
compared by value hash.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def E(sql: str) -> Column:
    """SQL expression text -> Column."""
    return F.expr(sql)


def add_cols(df, cols: dict[str, str]):
    """Add SQL-expression columns in one call (``withColumns`` for names that exist)."""
    existing = set(df.columns)
    new = {k: v for k, v in cols.items() if k not in existing}
    old = {k: v for k, v in cols.items() if k in existing}
    if new:
        df = df.selectExpr("*", *[f"{v} AS {k}" for k, v in new.items()])
    if old:
        df = df.withColumns({k: F.expr(v) for k, v in old.items()})
    return df


def agg_exprs(aggs: dict[str, str]) -> list[Column]:
    """Aggregate columns from {name: SQL}, one JVM call each."""
    return [F.expr(f"{v} AS {k}") for k, v in aggs.items()]


def lit(x: float) -> str:
    """A DOUBLE literal in scientific form (``55e-2`` is DOUBLE, ``0.55`` would be DECIMAL)."""
    return f"{float(x)!r}".replace("e+", "e") if "e" in f"{float(x)!r}" else f"{float(x)!r}e0"


def rnd(x: str, k: int = 0) -> str:
    """Round a non-negative value half up to ``k`` decimals (DOUBLE); one reference to x."""
    return f"(FLOOR(({x}) * {lit(10 ** k)} + 5e-1) / {lit(10 ** k)})"


def rnd_signed(x: str, k: int = 0) -> str:
    """Round half away from zero to ``k`` decimals for either sign; never -0.0."""
    m = lit(10 ** k)
    return (f"(CASE WHEN ({x}) < 0 THEN -CAST(FLOOR(-({x}) * {m} + 5e-1) AS BIGINT) / {m}"
            f" ELSE CAST(FLOOR(({x}) * {m} + 5e-1) AS BIGINT) / {m} END)")


def rnd_int(x: str) -> str:
    """Round a non-negative value to the nearest integer as INT."""
    return f"CAST(FLOOR(({x}) + 5e-1) AS INT)"


def scaled(x: str, k: int) -> str:
    """A non-negative value rounded to ``k`` decimals as an exact BIGINT of 10^-k units."""
    return f"CAST(FLOOR(({x}) * {lit(10 ** k)} + 5e-1) AS BIGINT)"


def scaled_signed(x: str, k: int) -> str:
    """A value of either sign rounded half away from zero, as an exact BIGINT of 10^-k units."""
    m = lit(10 ** k)
    return f"(CASE WHEN ({x}) < 0 THEN -CAST(FLOOR(-({x}) * {m} + 5e-1) AS BIGINT) ELSE CAST(FLOOR(({x}) * {m} + 5e-1) AS BIGINT) END)"


def mean_rounded(x: str, in_decimals: int, out_decimals: int) -> str:
    """Aggregate: round(avg(x), out) for a non-negative column rounded to ``in_decimals``,
    from an exact integer sum, so the result does not depend on the order rows are added."""
    q = f"SUM({scaled(x, in_decimals)}) / (COUNT({x}) * {lit(10 ** (in_decimals - out_decimals))})"
    return f"(FLOOR({q} + 5e-1) / {lit(10 ** out_decimals)})"


def safe_div(num: str, den: str, floor: float = 1e-9) -> str:
    return f"(({num}) / GREATEST({lit(floor)}, {den}))"


def clamp(x: str, lo: float, hi: float) -> str:
    return f"LEAST({lit(hi)}, GREATEST({lit(lo)}, {x}))"


def exact_sum(x: str, k: int = 6) -> str:
    """Aggregate: sum of ``x`` with every term fixed at ``k`` decimals and added as an
    exact BIGINT, so the total does not depend on the order rows meet in a shuffle."""
    m = lit(10 ** k)
    term = f"(CASE WHEN ({x}) < 0 THEN -CAST(FLOOR(-({x}) * {m} + 5e-1) AS BIGINT) ELSE CAST(FLOOR(({x}) * {m} + 5e-1) AS BIGINT) END)"
    return f"(CAST(SUM({term}) AS DOUBLE) / {m})"

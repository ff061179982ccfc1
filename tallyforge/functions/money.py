"""Exact money: sign rule, rounding, conversion, allocation."""

from __future__ import annotations

from decimal import ROUND_DOWN, ROUND_HALF_EVEN, ROUND_HALF_UP, ROUND_UP, Context, Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType

from tallyforge.schemas import AMOUNT

MODES = {"half_up": ROUND_HALF_UP, "half_even": ROUND_HALF_EVEN, "down": ROUND_DOWN, "up": ROUND_UP}
#: Enough digits for the product of two amounts.
_WIDE = Context(prec=80)


def zero() -> Column:
    return F.lit(Decimal(0)).cast(AMOUNT)


def signed(amount: str = "amount", entry_type: str = "entry_type", normal_side: str = "normal_side") -> Column:
    """The amount as it changes its account: positive on the normal side, else negative; null for an unknown side."""
    a, side = F.col(amount), F.col(normal_side)
    return F.when(~side.isin("debit", "credit"), None).when(F.col(entry_type) == side, a).otherwise(-a).cast(AMOUNT)


def total(value: Column, kind: str = AMOUNT) -> Column:
    """A sum as an amount (or another decimal), zero for none. Sums are cast back before they are added, or the last decimal is lost."""
    return F.coalesce(F.sum(value), F.lit(Decimal(0))).cast(kind)


def side_total(side: str, amount: str = "amount", kind: str = AMOUNT) -> Column:
    """The sum of the entries on one side."""
    return total(F.when(F.col("entry_type") == side, F.col(amount)).otherwise(zero()), kind)


def rounded(amount: Column, places: int, mode: str = "half_up") -> Column:
    """The amount at ``places`` decimals: half_up (away from zero), half_even, down (to zero) or up (from zero); an unknown mode is half_up."""
    if mode == "half_even":
        out = F.bround(amount, places)
    elif mode in ("down", "up"):
        size = F.floor(F.abs(amount), F.lit(places)) if mode == "down" else F.ceil(F.abs(amount), F.lit(places))
        out = F.when(amount < 0, -size).otherwise(size)
    else:
        out = F.round(amount, places)
    return out.cast(AMOUNT)


def is_precise(amount: Column, exponent: Column) -> Column:
    """Whether the amount has no more decimals than the currency's exponent (0 to 18)."""
    out = F.lit(False)
    for places in range(19):
        out = F.when(exponent == places, amount == F.round(amount, places)).otherwise(out)
    return out


@F.pandas_udf(DecimalType(30, 18))
def _converted(amount: pd.Series, rate: pd.Series, places: pd.Series, mode: pd.Series) -> pd.Series:
    def one(a: Decimal | None, r: Decimal | None, n: int, m: str) -> Decimal | None:
        if a is None or r is None:
            return None
        return _WIDE.multiply(a, r).quantize(Decimal(1).scaleb(-int(n)), MODES.get(m, ROUND_HALF_UP), _WIDE)

    return pd.Series([one(*x) for x in zip(amount, rate, places, mode, strict=True)], dtype=object)


def converted(amount: Column, rate: Column, places: int, mode: str = "half_up") -> Column:
    """amount * rate, exact before it is rounded. Spark's own product of two such decimals keeps 13 places only."""
    return _converted(amount.cast(AMOUNT), rate.cast(AMOUNT), F.lit(places), F.lit(mode))


def shares(amount: Decimal, weights: list[Decimal], places: int) -> list[Decimal]:
    """``amount`` (a whole number of units of ``places``) split by weight, what is left over going to the largest remainders, ties to the first."""
    unit = Decimal(1).scaleb(-places)
    units = Fraction(amount) / Fraction(unit)
    if units.denominator != 1 or not weights or any(w < 0 for w in weights) or not sum(weights):
        raise ValueError("the amount must be whole units and the weights non-negative with a positive sum")
    n, sum_of = abs(units.numerator), sum(map(Fraction, weights))
    exact = [n * Fraction(w) / sum_of for w in weights]
    out = [x.numerator // x.denominator for x in exact]
    for i in sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))[: n - sum(out)]:
        out[i] += 1
    sign = -1 if units < 0 else 1
    return [_WIDE.multiply(Decimal(sign * x), unit) for x in out]


@F.pandas_udf(ArrayType(DecimalType(30, 18)))
def _allocated(amount: pd.Series, weights: pd.Series, places: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or w is None else shares(a, list(w), int(p)) for a, w, p in zip(amount, weights, places, strict=True)], dtype=object)


def allocated(amount: Column, weights: Column, places: int) -> Column:
    """``shares`` as a column: an array of amounts that sum to ``amount``. Any number of digits."""
    return _allocated(amount.cast(AMOUNT), weights.cast(f"array<{AMOUNT}>"), F.lit(places))


def allocated_units(rows: DataFrame, key: list[str], units: str, weight: str, order: str, out: str = "share") -> DataFrame:
    """Largest-remainder shares of whole ``units`` by whole ``weight``, a row for each share, with windows over ``key``.

    For units * weight below 2**63; ``allocated`` has no such bound.
    """
    each = Window.partitionBy(*key)
    size = F.abs(F.col(units))
    found = rows.withColumn("_sum", F.sum(weight).over(each))
    found = found.withColumn("_floor", F.expr(f"abs({units}) * {weight} div _sum")).withColumn("_rest", F.expr(f"abs({units}) * {weight} % _sum"))
    found = found.withColumn("_left", size - F.sum("_floor").over(each)).withColumn("_rank", F.row_number().over(each.orderBy(F.desc("_rest"), order)))
    share = F.col("_floor") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)
    return found.withColumn(out, F.when(F.col(units) < 0, -share).otherwise(share)).drop("_sum", "_floor", "_rest", "_left", "_rank")


def fraction_of_units(units: str, num: str, den: str) -> Column:
    """units * num / den rounded half up, in whole units; units * num below 2**62."""
    return F.expr(f"(2 * {units} * {num} + {den}) div (2 * {den})")


def is_fraction(num: Column, den: Column) -> Column:
    """Whether num / den is a share: above zero, at most one."""
    return (den > 0) & (num > 0) & (num <= den)

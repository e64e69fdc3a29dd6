"""Small helpers for Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind a Column once inside an expression: lambdas in ``body`` would re-evaluate it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def general(number: Column | str, digits: int = 6) -> Column:
    """A number with ``digits`` significant digits and no zeros at the end, as C's ``%g`` prints it."""
    x = (F.col(number) if isinstance(number, str) else number).cast("double")
    shown = F.format_string(f"%.{digits - 1}e", x)  # rounded to the digits; the exponent behind the e
    power = F.substring_index(shown, "e", -1).cast("int")
    bare = lambda s: F.regexp_replace(s, r"\.?0+$", "")
    fixed = [F.when(power == p, F.format_string(f"%.{digits - 1 - p}f", x)) for p in range(-4, digits)]
    plain = F.coalesce(*fixed)
    plain = F.when(plain.contains("."), bare(plain)).otherwise(plain)
    mantissa = F.substring_index(shown, "e", 1)
    far = F.concat(bare(mantissa), F.lit("e"), F.substring_index(shown, "e", -1))
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(x == 0, "0")
    return odd.when((power >= -4) & (power < digits), plain).otherwise(far)

"""Spectral water indices as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import AWEI_EXPRESSION


def normalized_difference(a: Column, b: Column) -> Column:
    """(a-b)/(a+b); masked if either input is negative or the sum is zero."""
    return F.when((a >= 0) & (b >= 0), F.try_divide(a - b, a + b))


def ndwi(green: Column, nir: Column) -> Column:
    return normalized_difference(green, nir)


def mndwi(green: Column, swir1: Column) -> Column:
    return normalized_difference(green, swir1)


def awei(green: Column, swir1: Column, nir: Column, swir2: Column) -> Column:
    return F.lit(4) * (green - swir1) - (F.lit(0.25) * nir + F.lit(2.75) * swir2)


def band_expression(expression: str, bindings: dict[str, str]) -> Column:
    """Evaluate an expression string whose names are bound to band columns.

    ``band_expression('4*(GREEN-SWIR1)', {'GREEN': 'B3', 'SWIR1': 'B11'})``: each bound
    name (whole word) is replaced by its quoted column name and the text goes to
    ``F.expr`` - one JVM expression, no temporary columns.
    """
    import re
    pattern = re.compile(r"\b(" + "|".join(re.escape(k) for k in sorted(bindings, key=len, reverse=True)) + r")\b")
    return F.expr(pattern.sub(lambda m: f"`{bindings[m.group(1)]}`", expression))


def awei_expression(suffix: str = "") -> Column:
    return band_expression(AWEI_EXPRESSION, {"GREEN": "B3" + suffix, "SWIR1": "B11" + suffix,
                                             "NIR": "B8" + suffix, "SWIR2": "B12" + suffix})

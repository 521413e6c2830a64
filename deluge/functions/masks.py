"""Null-strict mask algebra.

A masked pixel is NULL.  Binary mask images are INT 0/1.  Integer arithmetic is
null-strict (any NULL input gives NULL), which is the semantics of pixel-wise image
algebra; SQL's three-valued AND/OR is not (NULL OR TRUE is TRUE), so it is not used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def m_and(a: Column, b: Column) -> Column:
    return a * b


def m_or(a: Column, b: Column) -> Column:
    return ((a + b) >= 1).cast("int")


def m_not(a: Column) -> Column:
    return F.lit(1) - a


def gt(c: Column, t) -> Column:
    return (c > F.lit(t)).cast("int")


def lt(c: Column, t) -> Column:
    return (c < F.lit(t)).cast("int")


def gte(c: Column, t) -> Column:
    return (c >= F.lit(t)).cast("int")


def eq(c: Column, t) -> Column:
    return (c == F.lit(t)).cast("int")


def update_mask(value: Column, mask: Column) -> Column:
    """Keep ``value`` where ``mask`` is valid and non-zero, else NULL."""
    return F.when(mask != 0, value)


def consensus(*flags: Column, at_least: int = 2) -> Column:
    """k-of-n vote of 0/1 flags (null-strict)."""
    total = flags[0]
    for f in flags[1:]:
        total = total + f
    return (total >= at_least).cast("int")


def change_code(post: Column, pre: Column) -> Column:
    """3 = persistent water, 2 = new water, 1 = lost water, 0 = no water."""
    persistent = m_and(post, pre)
    new = m_and(post, m_not(pre))
    lost = m_and(pre, m_not(post))
    return persistent * 3 + new * 2 + lost * 1

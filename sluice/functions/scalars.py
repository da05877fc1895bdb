"""Scalar expressions over ticks, quantities, ids and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.policy import STAMP_SHIFT

MAX_LONG = (1 << 63) - 1


def saturating_add(a: Column, b: Column) -> Column:
    """a + b of two non-negative numbers, at most the largest long."""
    return F.coalesce(F.try_add(a, b), F.lit(MAX_LONG))


def ticks_between(begin: Column, end: Column) -> Column:
    """Ticks from begin to end, never below zero; null if either is."""
    return F.when(end - begin < 0, F.lit(0)).otherwise(end - begin)


def div(a: Column, b: Column) -> Column:
    """The whole quotient of two non-negative longs."""
    return F.call_function("div", a, b)


def window_contains(begin: Column, end: Column, now) -> Column:
    """Whether the half-open window holds a tick."""
    return (F.lit(now) >= begin) & (F.lit(now) < end)


def stamp_cost(quantum: Column, weight: Column) -> Column:
    """What service of quantum costs a flow of that weight in its group's virtual time."""
    return div(F.shiftleft(quantum, STAMP_SHIFT), F.greatest(weight, F.lit(1)))


def id_text(family: str, value: Column) -> Column:
    """family#value, with 0 for an unbound id."""
    return F.concat(F.lit(family + "#"), F.coalesce(value, F.lit(0)).cast("string"))


def provenance_text(origin: Column, sequence: Column, digest: Column) -> Column:
    return F.concat(origin, F.lit("/seq="), sequence.cast("string"), F.lit("/digest="), digest.cast("string"))


def bounded_detail(text: Column, limit: int = 2048) -> Column:
    """Text with control characters as spaces, cut to limit bytes of which the last three are dots."""
    plain = F.regexp_replace(text, r"[\x00-\x1F\x7F]", " ")
    cut = F.substring(plain.cast("binary"), 1, limit - 3).cast("string")
    return F.when(F.octet_length(plain) > limit, F.concat(cut, F.lit("..."))).otherwise(plain)


def error_message(text: Column, limit: int = 512) -> Column:
    """A message of at most limit bytes."""
    return F.substring(text.cast("binary"), 1, limit).cast("string")


def nominal_work(estimated: Column, served: Column) -> Column:
    """Work that remains, never below zero."""
    return F.greatest(estimated - served, F.lit(0))


def first_match(arms: list[tuple[Column, Column | str]], otherwise) -> Column:
    """The value of the first arm whose condition holds; the order is the contract."""
    out = F
    for condition, value in arms:
        out = out.when(condition, value)
    return out.otherwise(otherwise)

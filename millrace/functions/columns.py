"""Column expressions shared by the warehouse jobs. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that separate words in a word count.
WORD_BREAKS = "[ \\t\\n\\r\\f]+"

# Modulus and multipliers of the repeatable point sequence used for the circle estimate.
# The modulus is a prime below 2**30, so every product below fits a signed 64-bit integer.
MIX_MODULUS = 2_147_483_647
MIX_FACTORS = (1_597_334_677, 747_796_405, 1_181_783_497)
MIX_SHIFTS = (15, 13, 16)
POINT_MODULUS = 1_000_000_007
POINT_X = 754_877_669
POINT_Y = 569_840_296


def money(amount: Column) -> Column:
    """An amount in whole cents as decimal."""
    return amount.cast("decimal(18,2)")


def total(amount: Column) -> Column:
    """Sum of an amount, returned as double.

    Decimals are summed exactly, so the total of a decimal column does not depend on the order
    of the rows; the last digits of a sum of doubles do.
    """
    return F.sum(amount).cast("double")


def mean(amount: Column) -> Column:
    """The sum divided by the number of values, NULL for a group without values."""
    return F.try_divide(total(amount), F.count(amount))


def pick(items: Sequence[str], position: Column) -> Column:
    """The item of a literal list at a 1-based position."""
    return F.element_at(F.array(*[F.lit(item) for item in items]), position.cast("int"))


def label(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def email_domain(email: Column) -> Column:
    """Text between the first and the second ``@``, NULL where there is no ``@``."""
    return F.get(F.split(email, "@"), F.lit(1))


def whole_quotient(number: Column, divisor: int) -> Column:
    """Integer division; exact for every 64-bit number, unlike a rounded fraction."""
    return F.call_function("div", number, F.lit(divisor))


def contact(name: Column, email: Column) -> Column:
    return F.concat(name, F.lit(" <"), email, F.lit(">"))


def moment(when: datetime) -> Column:
    """A zone-free timestamp literal; does not depend on the zone of the session or the driver."""
    return F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")


def seconds_after(start: str, seconds: Column) -> Column:
    """Zone-free timestamp ``seconds`` after ``start``; does not depend on the session time zone."""
    return F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def split_words(text: Column) -> Column:
    """Whole text cut at white space; the first and the last item may be empty."""
    return F.split(text, WORD_BREAKS)


def in_quarter_circle(number: Column) -> Column:
    """Whether the ``number``-th point of a fixed sequence over the unit square is in the circle.

    Integer arithmetic only, so the answer is the same on every engine and partitioning.
    """
    step = number % POINT_MODULUS
    x = (step * POINT_X) % POINT_MODULUS
    y = (step * POINT_Y) % POINT_MODULUS
    return x * x + y * y <= POINT_MODULUS * POINT_MODULUS


def uniform(key: Column, seed: int) -> Column:
    """A number from 0 to below 1, drawn by ``seed`` for each whole ``key``; a NULL key has none.

    Counter-based: key and seed are mixed by whole-number arithmetic, so the value depends on nothing else, neither
    on partitions nor on the order of rows nor on the engine. There are ``MIX_MODULUS`` different values.
    """
    mixed = (
        F.pmod(key, F.lit(MIX_MODULUS)) * MIX_FACTORS[0] % MIX_MODULUS
        + F.pmod(whole_quotient(key, MIX_MODULUS), F.lit(MIX_MODULUS)) * MIX_FACTORS[1] % MIX_MODULUS
        + seed * MIX_FACTORS[2] % MIX_MODULUS
    ) % MIX_MODULUS
    for shift, factor in zip(MIX_SHIFTS, MIX_FACTORS, strict=True):
        mixed = mixed.bitwiseXOR(F.shiftright(mixed, shift)) * factor % MIX_MODULUS
    return mixed.cast("double") / MIX_MODULUS

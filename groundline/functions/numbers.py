"""Spelled numbers, and numbers as tables print them."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SPELLED_MAX = 120
# fixed values: the words of numbers
UNDER_TWENTY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def spelled(n: int) -> str:
    """a number below 1000 in words, tens and ones with a hyphen."""
    if n >= 100:
        return f"{UNDER_TWENTY[n // 100 - 1]} hundred" + (f" {spelled(n % 100)}" if n % 100 else "")
    if n < 20:
        return UNDER_TWENTY[n - 1]
    return TENS[n // 10 - 2] + (f"-{UNDER_TWENTY[n % 10 - 1]}" if n % 10 else "")


@cache
def spelled_pattern(most: int = SPELLED_MAX) -> str:
    """A pattern of all spelled numbers up to `most`, longer ones first; any white space stands for a blank."""
    return "|".join(w.replace(" ", r"\s+") for w in sorted(map(spelled, range(1, most + 1)), key=len, reverse=True))


def in_words(n: Column, most: int = SPELLED_MAX) -> Column:
    return F.get(F.array(*(F.lit(spelled(i)) for i in range(1, most + 1))), n - 1)


def from_words(words: Column, most: int = SPELLED_MAX) -> Column:
    """The number that lower-case words with single blanks spell; null for others."""
    place = F.array_position(F.array(*(F.lit(spelled(i)) for i in range(1, most + 1))), words)
    return F.when(place > 0, place).cast("int")


def _shown(value: Column, text: Column) -> Column:
    return F.when(value.isNull(), "-").otherwise(text)


def _places(value: Column, places: int) -> Column:
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * places))


def percent(value: Column) -> Column:
    """a share with one decimal; a dash where it can't be measured."""
    return _shown(value, F.concat(_places(value * 100, 1), F.lit("%")))


def dollars(value: Column) -> Column:
    return _shown(value, _places(value, 4))


def ratio(value: Column) -> Column:
    return _shown(value, _places(value, 3))

"""Tax ids with a modulo-11 check digit, and personal names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BLANK, spaced, trimmed

# fixed values
#: Digits of a body whose number is worked with.
SHORT = 12
TAX_ID = r"^\d{1,3}(?:\.\d{3})*-[\dkK]$"
UNFINISHED = spaced(r"(?i)\s(DE|DEL|LA|LAS|LOS|Y|SAN|SANTA|DA|DOS|VON|VAN|MC|SAINT)$")


def looks_like_tax_id(s: Column) -> Column:
    return s.contains("-") & trimmed(s).rlike(TAX_ID)  # few texts need the pattern


def check_digit(body: Column) -> Column:
    """The check digit of a body of digits: weights 2 to 7 from the right, again and again. The digits of
    short bodies are taken from the number, which is compiled."""
    text = body.cast("string")
    places = F.filter(F.split(F.reverse(text), ""), lambda c: c != "")
    weighted = F.transform(places, lambda c, i: c.cast("int") * (i % 6 + 2))
    long = F.aggregate(weighted, F.lit(0), lambda a, x: a + x)
    number = text.try_cast("bigint")
    short = reduce(Column.__add__, [F.call_function("div", number, F.lit(10**k)) % 10 * (k % 6 + 2) for k in range(SHORT)]).cast("int")
    digits = F.length(text).between(1, SHORT) & (F.translate(text, "0123456789", "") == "")
    total = F.when(digits, short).otherwise(long)
    return F.substring(F.lit("0K987654321"), total % 11 + 1, F.lit(1))  # what is left to 11; 11 is 0, 10 is K


def tax_id(s: Column) -> Column:
    """struct<body, digit, valid, text>, or null for anything else."""
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  the text is worked out once

    def parts(t):
        body = F.replace(F.split_part(t, F.lit("-"), F.lit(1)), F.lit("."), F.lit(""))
        digit = F.upper(F.split_part(t, F.lit("-"), F.lit(2)))
        return F.struct(body.alias("body"), digit.alias("digit"), (digit == check_digit(body)).alias("valid"), t.alias("text"))

    return once(s, lambda s: F.when(looks_like_tax_id(s), once(trimmed(s), parts)))


def with_tax_id(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with tax_id() of a text column under a name. Each part is a column of a step of its own, so that it is
    worked out once and all is compiled."""
    step = rows.withColumn("_t", F.when(looks_like_tax_id(F.col(text)), trimmed(F.col(text))))
    part = lambda n: F.split_part(F.col("_t"), F.lit("-"), F.lit(n))
    step = step.withColumns({"_body": F.replace(part(1), F.lit("."), F.lit("")), "_digit": F.upper(part(2))})
    step = step.withColumn("_valid", F.col("_digit") == check_digit(F.col("_body")))
    whole = F.struct(F.col("_body").alias("body"), F.col("_digit").alias("digit"), F.col("_valid").alias("valid"), F.col("_t").alias("text"))
    return step.withColumn(name, F.when(F.col("_t").isNotNull(), whole)).drop("_t", "_body", "_digit", "_valid")


def split_name(s: Column) -> Column:
    """struct<paternal, maternal, given>: first and second word and the rest; two words are a
    paternal and a given name."""
    words = F.filter(F.split(trimmed(s), f"{BLANK}+"), lambda w: w != "")
    n = F.size(words)
    word = lambda k: F.coalesce(F.get(words, F.lit(k)), F.lit(""))
    rest = F.array_join(F.slice(words, 3, F.greatest(n - 2, F.lit(0))), " ")
    return F.struct(word(0).alias("paternal"), F.when(n > 2, word(1)).otherwise("").alias("maternal"), F.when(n > 2, rest).otherwise(word(1)).alias("given"))


def is_cut(shorter: Column, whole: Column) -> Column:
    """Whether a name is the beginning of a longer one, as a column of fixed width cuts it."""
    return (F.length(whole) > F.length(shorter)) & whole.startswith(shorter)


def unfinished_name(s: Column) -> Column:
    """Whether a name ends in a preposition or article, so that at least one word is missing."""
    return trimmed(s).rlike(UNFINISHED)

"""Comparison of nested JSON, level by level.

Both sides are walked together: a level is a table of values that stand at one place on both sides; only
objects and arrays that differ are opened, so equal subtrees cost nothing further, and there are as many
levels as the deepest difference.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cuts import cut

# fixed values: what stands for a container or a missing value in a report
ARRAY, OBJECT, MISSING = "(arreglo)", "(objeto)", "(ausente)"


def canonical(text: Column) -> Column:
    """JSON in one form; a text that isn't JSON counts as a string."""
    quoted = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.coalesce(F.to_json(F.try_parse_json(text)), quoted.substr(F.lit(2), F.length(quoted) - 2)))


def kind_of(json: Column) -> Column:
    first = F.substring(json, 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")


def type_of(json: Column) -> Column:
    """What a script calls the type: arrays and null are objects."""
    kind = kind_of(json)
    return F.when(kind.isin("array", "null"), "object").otherwise(kind)


def shown(json: Column) -> Column:
    """A string without its quotes, anything else as JSON."""
    return F.when(kind_of(json) == "string", F.variant_get(F.parse_json(json), "$", "string")).otherwise(json)


def _children(open_: DataFrame, side: str) -> DataFrame:
    """(pair, steps, within, side) of the members of one side's containers."""
    rows = open_.sparkSession.sql(f"SELECT pair, steps, kind AS within, c.pos, c.key, to_json(c.value) AS {side} FROM {{t}}, LATERAL variant_explode(parse_json({side})) AS c", t=open_)
    step = F.when(F.col("within") == "array", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
    return rows.select("pair", F.concat("steps", F.array(step)).alias("steps"), "within", side)


def _level(now: DataFrame) -> DataFrame:
    """(pair, path, kind, expected, actual): what differs among values at one level."""
    e, a, path = F.col("e"), F.col("a"), F.concat_ws("", "steps")
    ke, ka = kind_of(e), kind_of(a)
    in_object = F.col("within") == "object"
    numbers = (ke == "number") & (ka == "number")
    same = F.when(numbers, e.cast("double") == a.cast("double")).otherwise(e == a)
    size_e, size_a = F.json_array_length(e), F.json_array_length(a)
    text = lambda c: c.cast("string")
    row = lambda at, kind, x, y: F.struct(at.alias("path"), F.lit(kind).alias("kind"), text(x).alias("expected"), text(y).alias("actual"))
    told = (
        F.when(a.isNull(), F.when(in_object, row(path, "absent", shown(e), F.lit(MISSING))))
        .when(e.isNull(), F.when(in_object, row(path, "new", F.lit(None), shown(a))))
        .when((ke == "array") & (ka == "array"), F.when(size_e != size_a, row(F.concat(path, F.lit(".length")), "changed", size_e, size_a)))
        .when((ke == "object") & (ka == "object"), None)
        .when(ke == "array", row(path, "changed", F.lit(ARRAY), type_of(a)))
        .when(ke == "object", row(path, "changed", F.lit(OBJECT), type_of(a)))
        .when(~same, row(path, "changed", shown(e), shown(a)))
    )
    return now.select("pair", told.alias("d")).where("d is not null").select("pair", "d.*")


def nested_differences(pairs: DataFrame, keys: list[str], expected: str, actual: str, ignored: tuple[str, ...] = (".sha256",)) -> DataFrame:
    """(keys, path, kind, expected, actual) of the differences between two columns of JSON.

    A member that an object lacks is absent, one that only the actual object has is new; arrays are
    compared as far as both go and their lengths apart; where a container meets something else, nothing below
    it is compared. Numbers are equal by value. Differences at ignored paths are left out. Null
    columns are missing values; rows with equal keys are compared each for itself.
    """
    roots = cut(pairs.select(F.monotonically_increasing_id().alias("pair"), *[F.col(k).alias(f"_{k}") for k in keys], canonical(F.col(expected)).alias("e"), canonical(F.col(actual)).alias("a")))
    now = roots.select("pair", F.array().cast("array<string>").alias("steps"), F.lit("object").alias("within"), "e", "a").where("e is not null or a is not null")
    found = []
    while True:
        found.append(_level(now))
        kind = kind_of(F.col("e"))
        open_ = now.where((F.col("e") != F.col("a")) & kind.isin("object", "array") & (kind == kind_of(F.col("a")))).withColumn("kind", kind)
        if open_.isEmpty():
            break
        now = cut(_children(open_, "e").join(_children(open_, "a"), ["pair", "steps", "within"], "full_outer"))
    out = reduce(DataFrame.unionByName, found).where(~(F.col("path").isin(*ignored) & (F.col("kind") != "new")) if ignored else F.lit(True))
    return out.join(roots.select("pair", *[f"_{k}" for k in keys]), "pair").select(*[F.col(f"_{k}").alias(k) for k in keys], "path", "kind", "expected", "actual")

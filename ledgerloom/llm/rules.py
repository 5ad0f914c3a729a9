"""Quality rules: a threshold table compiled into one projection of ratios, with SQL functions only.

Text statistics come first, as columns; the table below names ratios of them with the bounds
that a kept document satisfies. The whole verdict is one Spark projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD

#: fixed values: frequent function words of English, Spanish, German and French
STOP_WORDS = (
    "a an and are as at be by for from had has have he in is it its not of on or that the they this to was were which with you "
    "al como con de del el en es la las lo los no para por que se su un una y "
    "als an auf aus das dem den der des die ein eine er für im in ist mit nicht sich sie und von zu "
    "au avec ce dans de des du elle en est et il la le les ne ou par pas pour qui sur un une"
).split()

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A kept document of at least `words` words has low <= numerator / denominator <= high."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None
    words: int = 1


#: The production table: length, symbol, stop-word and line ratios.
TABLE = (
    Rule("mean_word_chars", "word_chars", "n_words", low=2, high=20),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.25),
    Rule("exclamations_per_word", "n_exclamations", "n_words", high=0.3),
    Rule("upper_share", "n_upper", "n_letters", high=0.4),
    Rule("letter_share", "n_letters", "word_chars", low=0.5),
    Rule("stop_word_share", "n_stop_words", "n_words", low=0.02, words=60),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", high=0.4),
)
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20


def _kept(text: Column, drop: str) -> Column:
    """Code points that are left once `drop` is removed."""
    return F.length(F.regexp_replace(text, drop, "")).cast("long")


def repeated_words(words: Column, hashes: Column) -> Column:
    """How many words lie in a window whose hash occurs twice or more among a text's windows.

    hashes holds one 64-bit hash for each start of a window. Only texts with a repeated hash
    take the sort by (hash, place); covered words are then counted from the places in order.
    """
    order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    last = F.size(hashes) - 1
    twins = lambda o: F.filter(o, lambda s, j: ((j > 0) & (F.get(o, j - 1)["h"] == s["h"])) | ((j < last) & (F.get(o, j + 1)["h"] == s["h"])))
    places = F.array_sort(F.transform(_let(order, twins), lambda s: s["i"]))
    covered = _let(places, lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(total)


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once for each row."""
    return F.flatten(F.transform(F.array(value), then))


def statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and further counts
    that rules and features name) for every row of docs(doc_id, text, ...).

    keep names columns of docs to carry along; all others are left out.
    """
    text = F.col("text")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    words = whole.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n = F.size("words")
    window = lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)])
    starts = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    counted = words.select(
        "doc_id",
        *keep,
        n.cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        _kept(text, f"[{SPACE}]+").alias("word_chars"),
        _kept(text, SYMBOLS.replace("[", "[^") + "+").alias("n_symbols"),
        _kept(text, "[^!]+").alias("n_exclamations"),
        _kept(text, r"[^\p{L}]+").alias("n_letters"),
        _kept(text, r"[^\p{Lu}]+").alias("n_upper"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
        lines.alias("lines"),
        "words",
        starts.alias("starts"),
    )
    return counted.select(
        *[c for c in counted.columns if c not in ("lines", "words", "starts")],
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), F.col("starts")).alias("n_repeat_words"),
    )


def compiled(table=TABLE) -> Column:
    """The verdict of a threshold table on statistics, as one expression: true if all rules hold.
    A ratio whose denominator is 0, or a text of too few words for a rule, doesn't fail it."""
    verdict = F.lit(True)
    for r in table:
        over, under = F.col(r.numerator), F.col(r.denominator)
        holds = F.lit(True)
        if r.low is not None:
            holds &= over >= F.lit(r.low) * under
        if r.high is not None:
            holds &= over <= F.lit(r.high) * under
        verdict &= (F.col("n_words") < r.words) | (under == 0) | holds
    return verdict


def apply_rules(docs: DataFrame, table=TABLE) -> DataFrame:
    """statistics(docs) with base_failed and kept.

    A null text counts as empty and fails for want of words. Repeated rows are each returned;
    other columns are ignored; texts of any length are taken whole; no rows give no rows. n_repeat_words counts word places inside 5-word windows that
    occur twice or more in the text; windows are compared by 64-bit hashes.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return statistics(docs).withColumn("base_failed", failed).withColumn("kept", ~failed & compiled(table))

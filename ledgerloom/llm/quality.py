"""Quality classifier: a sparse rule ensemble over text statistics.

A small random forest is grown on a bounded labelled sample; every path from a root to a node
is a conjunction of thresholds, a rule. An L1-penalised logistic regression over the rules' 0/1
columns leaves few of them with a weight, and those are compiled into one column expression,
so scoring is a projection of SQL functions.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialize
from .labelled import held_out, training_rows
from .rules import statistics

FOLDS, HELD, THRESHOLD = 5, 0, 0.3
#: Labelled rows that a model may be fitted on.
TRAIN_ROWS = 20_000
TREES, DEPTH, PENALTY = 16, 3, 0.001

#: Features, as ratios of text statistics; a ratio by zero is 0.
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "exclamations_per_word": ("n_exclamations", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "letter_share": ("n_letters", "word_chars"),
    "stop_word_share": ("n_stop_words", "n_words"),
    "duplicate_line_share": ("n_dup_lines", "n_lines"),
    "repeated_word_share": ("n_repeat_words", "n_words"),
    "distinct_word_share": ("n_distinct_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}
FEATURES = [*RATIOS, "log_words"]

_LINE = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)")
_OTHER = re.compile(r"^\s*$|^\w+Model.*$|^ *Tree \d+ .*$|^ *Predict: [-+.\dEe]+$")


@dataclass(frozen=True)
class Rule:
    """Holds where every feature lies in its (low, high] range."""

    ranges: tuple[tuple[int, float, float], ...]

    def column(self) -> Column:
        holds = F.lit(True)
        for feature, low, high in self.ranges:
            value = F.col(FEATURES[feature])
            if low > -math.inf:
                holds &= value > F.lit(low)
            if high < math.inf:
                holds &= value <= F.lit(high)
        return holds


@dataclass(frozen=True)
class Model:
    bias: float
    weights: tuple[tuple[Rule, float], ...] = ()

    def score(self) -> Column:
        """The probability of label 1 as one expression over FEATURES."""
        total = F.lit(self.bias)
        for rule, w in self.weights:
            total = total + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def features(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """statistics(docs) reduced to doc_id, the columns of docs named by keep, and FEATURES."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return statistics(docs, keep).select("doc_id", *keep, *[ratio(a, b).alias(name) for name, (a, b) in RATIOS.items()], F.log1p("n_words").alias("log_words"))


def tree_rules(debug_string: str) -> list[Rule]:
    """The rules of all paths in a tree ensemble's printed form; a line of any other form is refused."""
    found, path = {}, []
    for line in debug_string.splitlines():
        if "Tree " in line:
            path = []
        elif m := _LINE.match(line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, int(m[2]), m[3], float(m[4]))]
            ranges: dict[int, tuple[float, float]] = {}
            for _, feature, sign, value in path:
                low, high = ranges.get(feature, (-math.inf, math.inf))
                ranges[feature] = (low, min(high, value)) if sign == "<=" else (max(low, value), high)
            found[Rule(tuple((f, *ranges[f]) for f in sorted(ranges)))] = None
        elif not _OTHER.match(line):
            raise ValueError(f"not a line of a tree: {line!r}")
    return list(found)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_ROWS, seed: int = 7) -> Model:
    """A model from at most `limit` labelled rows outside the held-out fold.

    Without rows of both classes the model is their rate, or 0.5 without rows.
    """
    sample = training_rows(id_text(docs), labels, label, FOLDS, HELD, limit)
    wide = materialize(features(sample, keep=("label",)))
    n, positive = wide.agg(F.count("*"), F.sum("label")).first()
    if not n or positive in (0, n):
        rate = (positive + 0.5) / (n + 1) if n else 0.5
        return Model(math.log(rate / (1 - rate)))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(wide.coalesce(4)).select("features", "label", *FEATURES)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=seed, featureSubsetStrategy="0.5").fit(rows)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        rate = (positive + 0.5) / (n + 1)
        return Model(math.log(rate / (1 - rate)))
    marked = rows.select("label", *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    marked = materialize(VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(marked).select("features", "label"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60).fit(marked.coalesce(4))
    return Model(float(lasso.intercept), tuple((rules[i], float(w)) for i, w in enumerate(lasso.coefficients.toArray()) if abs(w) > 1e-6))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text, ...).

    A null text is scored as an empty one. Repeated rows are each returned; a null doc_id isn't
    held out; texts of any length are taken whole; no rows give no rows. Other columns of docs
    (lang, source, labels) are never read.
    """
    scored = features(docs).select("doc_id", held_out(FOLDS, HELD).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model doesn't reject, as they are, columns of any name included.

    A null text is judged as an empty one, and texts of any length whole. Repeated rows stand or
    fall together and are each returned; no rows give no rows.
    """
    rows = docs.withColumn("_row", F.struct(*docs.columns))
    # The optimizer would write a filter on the score in terms of the raw text, each statistic
    # once for every rule that names it. A value it holds for not repeatable stays where it is.
    scored = F.when(F.monotonically_increasing_id() >= 0, model.score())
    return features(rows, keep=("_row",)).select("_row", scored.alias("_score")).where(F.col("_score") >= THRESHOLD).select("_row.*")

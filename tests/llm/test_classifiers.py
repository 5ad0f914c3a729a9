import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import quality, rules, toxicity

DOCS = "doc_id long, text string, lang string, source string, score string"


def corpus(n=400):
    rnd = random.Random(1)
    words = ["the", "of", "and", "in"] + ["word%d" % i for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        good, toxic = rnd.random() < 0.7, rnd.random() < 0.3
        w = rnd.choices(words, k=rnd.randrange(15, 200))
        if toxic:
            w[rnd.randrange(len(w))] = rnd.choice(["Idiot!", "scum,", "blockheaded", "blockhead"])
        docs.append((i, " ".join(w) if good else " ".join(x + "###" for x in w), "en", "s", "clash"))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def auc(y, s):
    y, s = np.array(y), np.array(s)
    return (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()


@pytest.mark.parametrize("op,column,folds,held", [(quality, 1, 5, 0), (toxicity, 2, 4, 2)])
def test_held_out_accuracy_and_edges(spark, op, column, folds, held):
    docs, labels = corpus()
    extra = [(9000, None, None, None, None), (9001, "", "en", "s", "c"), (None, "no id", None, None, None), docs[0], (9002, "x" * 200000, "en", "s", "c")]
    df = spark.createDataFrame(docs + extra, DOCS)
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    rows = op.score(df, op.fit(df, lab)).collect()
    assert len(rows) == len(docs) + len(extra)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in rows)
    truth = {x[0]: x[column] for x in labels}
    mine = [(truth[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert auc(*zip(*mine)) > 0.97
    assert op.score(df.limit(0), op.fit(df, lab)).count() == 0


@pytest.mark.parametrize("op", [quality, toxicity])
def test_held_out_labels_are_never_learnt(spark, op):
    docs, labels = corpus(120)
    df = spark.createDataFrame(docs, DOCS)
    folds, held = op.FOLDS, op.HELD
    flipped = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % folds == held else (i, q, t) for i, q, t in labels]
    a, b = (op.score(df, op.fit(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int"))).orderBy("doc_id").select("score").collect() for x in (labels, flipped))
    assert np.allclose([r[0] for r in a], [r[0] for r in b])


@pytest.mark.parametrize("op", [quality, toxicity])
def test_one_class_or_no_labels(spark, op):
    df = spark.createDataFrame([(1, "a b", "en", "s", "c"), (2, None, None, None, None)], DOCS)
    schema = "doc_id long, quality int, toxic int"
    for rows, low, high in (([], 0.5, 0.5), ([(1, 1, 1), (3, 1, 1)], 0.5, 1), ([(1, 0, 0)], 0, 0.5)):
        scores = [r["score"] for r in op.score(df, op.fit(df, spark.createDataFrame(rows, schema))).collect()]
        assert len(scores) == 2 and all(low <= s <= high for s in scores)


def test_keep_good_keeps_rows_as_they_are(spark):
    docs, labels = corpus(200)
    df = spark.createDataFrame(docs + [(9000, None, None, None, None)], DOCS)
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and quality.keep_good(df.limit(0), model).count() == 0
    long, clash = ("the word of it " * 40000), df.withColumnsRenamed({"lang": "n_words", "source": "_score"})
    more = clash.union(spark.createDataFrame([(9100, long, "x", "y", None), (9100, long, "x", "y", None)], DOCS))
    assert quality.keep_good(more, model).columns == clash.columns and quality.keep_good(more, model).where("doc_id = 9100").count() in (0, 2)
    good = {r["doc_id"] for r in quality.score(df, model).where("predicted = 1").collect()}
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((d for d in [*docs, (9000, None, None, None, None)] if d[0] in good), key=str)


def test_rule_scores_against_plain_python(spark):
    """The compiled expression against the rules applied one by one to statistics counted in Python."""
    docs, labels = corpus(150)
    docs += [(9000, None, None, None, None), (9001, "", "en", "s", "c"), (9002, "one two\none two\n\nA! B!", "en", "s", "c"), (9003, "a b c d e " * 300, "en", "s", "c")]
    df = spark.createDataFrame(docs, DOCS)
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.weights

    def values(text):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeated = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        letters = [c for c in text if c.isalpha()]
        n = {
            "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_exclamations": text.count("!"), "n_letters": len(letters), "n_upper": sum(c.isupper() for c in letters),
            "n_stop_words": sum(x.lower() in set(rules.STOP_WORDS) for x in w), "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines), "n_repeat_words": len(repeated), "n_distinct_words": len(set(w)),
        }
        return [n[a] / n[b] if n[b] else 0.0 for a, b in quality.RATIOS.values()] + [math.log1p(len(w))]

    got = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    for d, t, *_ in docs:
        x = values(t)
        total = model.bias + sum(weight for rule, weight in model.weights if all(low < x[f] <= high for f, low, high in rule.ranges))
        assert abs(got[d] - 1 / (1 + math.exp(-total))) < 1e-9


def plain_features(text):
    """The features of a text as the words and pairs themselves."""
    w = re.findall(r"\w+", text.lower())
    out = {("w", x) for x in w} | {(k, x[:k]) for x in w for k in (4, 5, 6, 7)}
    return out | {(g, *w[i : i + 1], *w[i + g : i + g + 1]) for g in (1, 2, 3) for i in range(len(w) - g)} | {("t", *w[i : i + 3]) for i in range(len(w) - 2)}


def test_features_are_words_starts_grams_and_skips():
    rnd = random.Random(2)
    texts = ["", "one", "Éa b", "a a a a a"] + [" ".join(rnd.choices(["alpha", "Beta", "gammaray", "gammaglobin", "d"], k=rnd.randrange(30))) for _ in range(200)]
    for t in texts:
        assert len(toxicity.feature_ids(t)) == len(plain_features(t))  # few enough not to collide
        assert set(toxicity.buckets(t)) == set(toxicity.feature_ids(t).tolist())


def test_ftrl_against_plain_python():
    """Sequential FTRL-proximal over a dictionary of weights, and rare features change nothing."""
    docs, labels = corpus(150)
    y = [t for *_, t in labels]
    rows = [toxicity.feature_ids(d[1]) for d in docs]
    bias, at, weights = toxicity.train(rows, np.array(y, float))
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    rate = (sum(y) + 0.5) / (len(y) + 1)
    b, bn, order = math.log(rate / (1 - rate)), 1.0, np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(rows)):
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, b + sum(map(weight, rows[k].tolist())))))) - y[k]
            for i in rows[k].tolist():
                w = weight(i)
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w
                n[i] += g * g
            bn += g * g
            b -= 0.1 * g / math.sqrt(bn)
    want = {i: weight(i) for i in z if weight(i)}
    assert abs(b - bias) < 1e-6 and want.keys() == set(at.tolist()) and all(abs(want[i] - w) < 1e-4 for i, w in zip(at.tolist(), weights.tolist()))
    seen = Counter(i for r in rows for i in r.tolist())
    some = [r[[seen[i] * toxicity.EPOCHS > toxicity.L1 for i in r.tolist()]] for r in rows]
    again = toxicity.train(some, np.array(y, float))
    assert again[1].tolist() == at.tolist() and np.allclose(again[2], weights) and abs(again[0] - bias) < 1e-9


def test_recall_on_held_out_labels_of_the_tables(spark):
    """With some 3,000 labels; with a tenth of them too few toxic words are seen (see README)."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    print("caught", sum(toxic), "of", len(toxic), "false", sum(r["predicted"] and not r["toxic"] for r in rows))
    assert sum(toxic) >= 0.9 * len(toxic) and sum(r["predicted"] and not r["toxic"] for r in rows) <= 0.02 * len(rows)


def test_tree_rules_refuse_other_lines():
    with pytest.raises(ValueError, match="not a line"):
        quality.tree_rules("Model: uid=x\n  Tree 0 (weight 1.0):\n    If (feature 0 in {1.0})\n")


def test_tree_rules_merge_bounds():
    text = """RandomForestClassificationModel: uid=x
  Tree 0 (weight 1.0):
    If (feature 0 <= 2.5)
     If (feature 0 <= 1.5)
      Predict: 0.0
     Else (feature 0 > 1.5)
      Predict: 1.0
    Else (feature 0 > 2.5)
     Predict: 1.0
"""
    inf = float("inf")
    assert [r.ranges for r in quality.tree_rules(text)] == [((0, -inf, 2.5),), ((0, -inf, 1.5),), ((0, 1.5, 2.5),), ((0, 2.5, inf),)]

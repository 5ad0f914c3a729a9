import hashlib
import os
import random
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import mixing, simhash
from ledgerloom.llm.common import into, shared_dir

from .test_mixing import brute as brute_mix
from .test_simhash import brute as brute_groups


def corpus(tmp_path, spark):
    rnd = random.Random(12)
    words = ["the", "of", "and", "in"] + ["word%d" % i for i in range(300)]
    docs, labels = [], []
    for i in range(260):
        good = rnd.random() < 0.75
        w = rnd.choices(words, k=rnd.randrange(30, 150))
        if i % 9 == 0:
            w.insert(3, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"')
        docs.append((i, " ".join(w if good else (x + "###" for x in w)), rnd.choice(["en", "de", None]), rnd.choice(["src0", "src0", "src1"]), 0))
        labels.append((i, int(good), 0))
    docs += [(1000 + i, docs[i][1], "en", "src2", 0) for i in range(40)]  # exact copies
    docs += [(2000 + i, docs[i][1].replace(" ", " x ", 1), "en", "src3", 0) for i in range(20)]
    docs = [(d, t, lang, s, len(t)) for d, t, lang, s, _ in docs] + [(5000, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return docs


def test_stages_against_plain_versions(spark, tmp_path):
    docs = corpus(tmp_path, spark)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    seen = [docs]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/stage{n}")
        now = spark.read.parquet(f"{tmp_path}/stage{n}")
        assert n == 4 or now.columns == columns
        seen.append(sorted(map(tuple, now.collect()), key=str))
    good, single, masked, mixed, coded = seen[1:]

    assert set(good) <= set(docs) and {d[0] for d in docs if d[1] and "###" not in d[1]} <= {d[0] for d in good}
    assert sum("###" in (d[1] or "") for d in good) == 0
    groups = brute_groups([(d[0], d[1]) for d in good])
    assert [d[0] for d in single] == sorted({c for *_, c in groups}, key=str) or {d[0] for d in single} == {c for *_, c in groups}
    assert set(single) <= set(good) and len(single) == len({c for *_, c in groups})
    mask = lambda t: re.sub(r'token = "[A-Za-z0-9+/_.=-]{12,}', "<assign>", t)  # noqa: E731  the one secret in these texts
    hidden = [(d, t, lang, s, n) if t is None else (d, mask(t), lang, s, len(mask(t))) for d, t, lang, s, n in single]
    assert masked == sorted(hidden, key=str)
    assert not any("04dbebab91ab85687d33" in (d[1] or "") for d in masked) and any("<assign>" in (d[1] or "") for d in masked)

    domain = dict(spark.createDataFrame([(s,) for s in {d[3] for d in masked}], "s string").select("s", mixing.domain_of(mixing.F.col("s"))).collect())
    want = brute_mix([(d, t, lang, s, domain[s], None) for d, t, lang, s, _ in masked], mixing.PRODUCTION)
    assert sorted(d[0] for d in mixed) == sorted(d[0] for d in want) and set(mixed) <= set(masked)

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = [(d, lib.encode(t or "", add_special_tokens=False).ids, t or "") for d, t, *_ in mixed]
    assert coded == sorted(((d, len(x), sha(",".join(map(str, x))), sha(t)) for d, x, t in ids), key=str)
    made = []
    with into(made):
        assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == coded
    there = os.listdir(shared_dir(spark).removeprefix("file:"))
    assert [os.path.basename(p) in there for p in made] == [True]  # what the last stage reads


def test_edges(spark, tmp_path):
    """No documents; no labels; a null, a repeated and a very long text; a column with another's name."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string"
    rows = [(1, "the cat of a house " * 20000, "en", "s", 1, "x"), (2, None, None, None, None, None), (2, None, None, None, None, None), (3, "", "en", "s", 0, "y"), (4, "some words of it in a row here", "en", "s", 3, "z")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, some in (("none", []), ("few", rows)):
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        out = corpus_pipeline.run(spark, sf).collect()
        assert {r["doc_id"] for r in out} <= {d for d, *_ in some} and (some or not out)
        assert all(r["n_tokens"] > 0 for r in out)


def test_representatives_follow_components(spark):
    df = spark.createDataFrame([(2, "a b c d e"), (1, "a b c d e"), (3, "q")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_representatives(df).collect()) == [1, 3]

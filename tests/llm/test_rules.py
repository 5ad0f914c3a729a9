import random
import re
from collections import Counter

import duckdb

from ledgerloom.llm import queries, rules

SCHEMA = "doc_id long, text string, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    return (*n, n[0] < 10 or 100 * n[4] > 20 * n[0])


def test_base_columns_against_brute_force(spark):
    rnd = random.Random(6)
    texts = [None, "", " \n ", "a", "a b c d e a b c d e", "a a a a a a a", "x\n\nx\r\nx\n x\nx", "#*$%&|<>   é😀", "a b c d e f a b c d e g " * 900, "one two " * 9000, "\u0085   a"]
    texts += ["".join(rnd.choices(["a", "b", "c", "dd", " ", " ", " ", "\n", "\t", "#"], k=rnd.randrange(200))) for _ in range(300)]
    rows = [*enumerate(texts), (3, "a"), (3, "a"), (None, "b " * 12)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    out = rules.apply_rules(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((d, *brute(t)) for d, t in rows), key=str)
    assert rules.apply_rules(df.limit(0)).count() == 0


def test_verdicts(spark):
    prose = "the cat sat on the mat and looked at %d birds in the garden with an old friend of mine "
    clean = " ".join(prose % i + f"word{i} other{i} thing{i}" for i in range(9))
    texts = {1: clean, 2: clean.upper().replace(" ", "!! "), 3: clean.replace(" ", "### "), 4: clean.replace(" ", " | "), 5: "short text", 6: " ".join("q%dx" % i for i in range(100)), 7: "Sí, el gato está en la casa de mi amigo con una pelota roja"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in rules.apply_rules(df, rules.TABLE).select("doc_id", "kept").collect()} == {1: False, 2: False, 3: False, 4: False, 5: False, 6: False, 7: True} | {1: brute(clean)[-1] is False}


def test_oracle(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    want = duckdb.sql(queries.oracle_sql()["op6_quality_rules"].replace("FROM documents", f"FROM '{src}/documents.parquet'")).df()
    got = queries.queries()["op6_quality_rules"](spark, src).toPandas()
    key = sorted(got.columns)
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, want[key].values.tolist()))

import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
HARD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "▁", "a▁b", "▁▁a", "<s>", "<unk> </s>", "<0x0A>", "\n", "\n \n", "\t a", "日本 語", "😀 a", "\u0000 x", "x\u0000", "é", "a b", "ﬁ", "ab " * 9000, "z" * 5000, " " * 700]


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_tokens long")
    return sorted(map(tuple, token_counts.token_counts(df, PATH).collect()), key=str)


def want(rows):
    return sorted(((d, len((t or "").encode()), len(SP.encode(t or ""))) for d, t in rows), key=str)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁ab\nE.é日"), st.characters(codec="utf-8")), max_size=30))
def test_pretokens_sum_to_the_whole(text):
    assert sum(token_counts.piece_counts(PATH, token_counts.pretokens(text))) == len(SP.encode(text))


def test_against_the_library(spark, monkeypatch):
    rnd = random.Random(4)
    rows = list(enumerate(HARD)) + [(1000 + i, " ".join(rnd.choices(["the", "of", "Wörter", "x1", "zz%d" % i, "über-lang"], k=rnd.randrange(300)))) for i in range(60)]
    rows += [(7, "again"), (7, "again"), (7, "other"), (None, "no id"), (None, None)]
    assert run(spark, rows) == want(rows)
    monkeypatch.setattr(token_counts, "HEAD", 3)  # nearly all pre-tokens take the join
    monkeypatch.setattr(token_counts, "HELD", 5)
    assert run(spark, rows) == want(rows)


def test_long_pretokens_go_by_digest(spark, monkeypatch):
    url = "https://example.org/" + "a/very/long/path/" * 9
    rows = [(i, f"see {url} and {url}x{i} and {'日本' * 40}") for i in range(40)] + [(None, url)] * 3
    digest = token_counts.key(url)
    assert len(digest) == token_counts.LONG + 1 and token_counts.key("a" * 64) == "a" * 64
    rows.append((99, f"{digest} {url}"))
    assert run(spark, rows) == want(rows)
    monkeypatch.setattr(token_counts, "HEAD", 2)
    assert run(spark, rows) == want(rows)


def test_empty(spark):
    assert run(spark, []) == []

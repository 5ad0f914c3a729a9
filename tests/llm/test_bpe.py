import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
VOC, DEC = bpe.vocabulary(PATH), bpe.decoder(PATH)
HARD = [None, "", " ", "a", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "\n\n a", " " * 300, "a" * 4000, "don't'LL", "１２3 ٣", "é́", "😀😀", "\u0085  x", "\x1c\x1d a", "the " * 20000]


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" abeint'\n1<|>"), st.characters(codec="utf-8", max_codepoint=0x2FFF)), max_size=60))
def test_same_ids_and_round_trip(text):
    ids = VOC.encode(text)
    assert ids.tolist() == LIB.encode(text, add_special_tokens=False).ids
    assert DEC.decode(ids) == text


def test_words_made_of_tokens():
    rnd = random.Random(8)
    for _ in range(1500):
        word = b"".join(rnd.choices(VOC.bytes, k=rnd.randrange(1, 9))).decode("latin-1")
        assert VOC.encode(word).tolist() == LIB.encode(word, add_special_tokens=False).ids


def test_documents(spark):
    rows = list(enumerate(HARD)) + [(3, "a"), (3, "a"), (None, "b")]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.digest(bpe.decode(bpe.encode(df, PATH), PATH)).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in rows:
        ids = LIB.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(LIB.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    assert sorted(map(tuple, bpe.digest(bpe.round_trip(df, PATH)).collect()), key=str) == sorted(want, key=str)
    assert bpe.encode(df.limit(0), PATH).count() == 0 and bpe.round_trip(df.limit(0), PATH).count() == 0


def test_decoding_null_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [64])], "doc_id long, ids array<int>")
    assert sorted(r["text"] for r in bpe.decode(df, PATH).collect()) == ["", "", "a"]

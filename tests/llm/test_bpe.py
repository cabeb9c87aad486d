import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motifspark.llm import bpe
from motifspark.llm.textbatch import Chunk

BPE = bpe.ByteBPE(bpe.tokenizer_source())


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


LIB = library()
CASES = [
    "", " ", "  a", "a  b\n\nc \n d", "it's I'll we've !'s €'s é's x'ré", "a b  c　d\u0085e", "<|endoftext|>", "x <|endoftext|>  y  <|endoftext|>",
    "ab<|endoftext|", "1234 567a8", "ÀÉß ñó çà", "日本語テキスト 한국어", "😀😃 👨‍👩‍👧", "a" * 5000, "ab" * 3000, "é" * 700, "\n" * 300, " " * 301 + "x", "!?" * 400, "\x00\x01\x1c\x1f z",
]


def check(texts):
    chunk = Chunk.of(texts)
    ids, first = BPE.encode(chunk)
    got = [ids[a:b].tolist() for a, b in zip(first, first[1:])]
    want = [LIB.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got == want
    assert BPE.decode(ids, first).to_pylist() == [LIB.decode(i, skip_special_tokens=False) for i in want]


def test_same_ids_as_the_library():
    check(CASES)
    check([None, "a", None])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeth' \n\t!1<|> é.s"))), max_size=4))
def test_same_ids_on_random_texts(texts):
    check(texts)


def test_decode_of_odd_ids():
    ids = np.array([50257, -1, BPE.byte_id[0xC3], BPE.byte_id[0x41]], np.int32)
    assert BPE.decode(ids, np.array([0, 3, 4])).to_pylist() == ["�", "A"]


def test_operator(spark):
    rows = [(1, "Hello  world", "x"), (2, None, "y"), (2, None, "y"), (None, "<|endoftext|>!", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.round_trip(docs, carry=["doc_id", "text"])
    got = sorted(((r["doc_id"] or 0), r["decoded"], r["ids"]) for r in out.collect())
    assert got == sorted(((i or 0), t or "", LIB.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
    assert {r["decoded"] for r in bpe.decode(bpe.encode(docs, carry=["doc_id"])).collect()} == {"Hello  world", "", "<|endoftext|>!"}
    assert bpe.encode(docs).columns == ["doc_id", "text", "ids", "ids"]
    assert out.where(F.lit(False)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in bpe.op2_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        ids = LIB.encode(r["text"] or "", add_special_tokens=False).ids
        mine = got[r["doc_id"]]
        assert mine["n_tokens"] == len(ids)
        assert mine["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert mine["decoded_sha256"] == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()

"""BPE and token counts against the tokenizers library."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weirflow.llm import bpe, queries, token_counts
from weirflow.llm.tokenizer import Vocabulary, default_path

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, "a<|endoftext|>b  \n\n <|endoftext|>\t x.<|endoftext|>"), (3, "a<|endoftext|>b  \n\n <|endoftext|>\t x.<|endoftext|>"),
    (None, "it's we'll     x\u0085y éà 日本語 テスト 🙂🙂 123١٢ ___ =====\r\n\r\n"), (5, "=" * 5000 + "x" * 3000 + " " * 2000), (6, "hello hello world"), (1, "other"), (7, "word " * 40_000), (8, "new letters \U00011f04\U00011f05x, \U0001fae8 and \u0cf3 1"),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("head", [bpe.HEAD_WORDS, 8, 0])
def test_encode_and_decode_odd_texts(spark, library, head, monkeypatch):
    if head == 8:  # many runs, groups of them and answers by share
        for name, n in (("RUN", 4), ("TOGETHER", 2), ("ASKING", 3)):
            monkeypatch.setattr(bpe, name, n)
    df = spark.createDataFrame(ODD, "doc_id long, text string").select("*", F.lit(1).alias("ids"), F.lit(2).alias("h"))
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.decode(bpe.encode(df, head_words=head)).collect())
    want = Counter()
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == want


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(none)).collect() == [] and token_counts.token_counts(none).collect() == []


def test_decode_replaces_broken_bytes_and_takes_null(spark, library):
    broken = library.encode("é🙂", add_special_tokens=False).ids[:-1]
    df = spark.createDataFrame([(1, broken, "old"), (2, None, "old"), (3, [50256], "old")], "k int, ids array<int>, decoded string")
    got = {r.k: r.decoded for r in bpe.decode(df).collect()}
    assert got == {1: library.decode(broken, skip_special_tokens=False), 2: "", 3: "<|endoftext|>"}


def test_op1_on_the_table(spark, library):
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, queries.op1_bpe(spark, SF).collect())) == sorted(want)


def test_token_counts(spark, library):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted(map(tuple, token_counts.token_counts(df, piece_chars=1000, batch_bytes=5000).collect()), key=repr)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in ODD]
    assert got == sorted(want, key=repr)


def test_op2_on_the_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted((r.doc_id, len(r.text.encode()), n := len(library.encode(r.text, add_special_tokens=False).ids), n > 512) for r in docs)
    assert sorted(map(tuple, queries.op2_token_counts(spark, SF).collect())) == want


def test_safe_pieces_join_up():
    text = "ab  cd\n\nef " * 100 + "x" * 500 + " y"
    pieces = token_counts.safe_pieces(text, 7)
    assert "".join(pieces) == text and len(pieces) > 50
    assert all(a[-1].strip() and not b[0].strip() for a, b in zip(pieces, pieces[1:]))


def test_pieces_cover_the_vocabulary():
    pieces = Vocabulary.load(default_path()).pieces()
    assert len(pieces) == 50257 and pieces[50256] == b"<|endoftext|>" and len(set(pieces)) == len(pieces)

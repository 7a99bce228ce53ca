import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spindrift.llm import bpe, op_token_counts, token_counts

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_odd_rows_against_the_library(spark):
    texts = [None, "", " ", "a", "<|endoftext|> inside", "日本語 ²½ e\u0301", "\x00\n\n\t", "word " * 60_000, "x" * 200_000, "é" * 70_000 + " end", "a b"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(0, "a b", 2), (None, "a b", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    got = token_counts.count_tokens(df, op_token_counts.VOCABULARY).collect()
    assert len(got) == len(rows) and got[0].tokens == 1
    for r in got:
        n = len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 1024)
    assert token_counts.count_tokens(df.limit(0), op_token_counts.VOCABULARY).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 7)], "doc_id long, text string, n_tokens int")
    with pytest.raises(ValueError, match="exist already"):
        token_counts.count_tokens(df, op_token_counts.VOCABULARY)
    row = token_counts.count_tokens(df, op_token_counts.VOCABULARY, prefix="bpe_").first()
    assert (row.n_tokens, row.bpe_n_tokens) == (7, 2)


def test_query_against_the_library(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in op_token_counts.query(spark, d).collect()}
    assert got == {k: (len((t or "").encode()), len(LIBRARY.encode(t or "", add_special_tokens=False).ids)) for k, t in texts.items()}


def test_texts_without_a_boundary_are_read_once_or_twice():
    read = []

    def encode(text):
        read.append(len(text))
        return [len(text)], [1], b"\x07\0\0\0"

    assert b"".join(bpe.spliced("x" * 100_000, encode, 1000, 16)) == b"\x07\0\0\0"
    assert sum(read) <= 5 * 100_000

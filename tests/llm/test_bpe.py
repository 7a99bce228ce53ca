import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spindrift.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = bpe.Encoder(PATH)
ODD = ["", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n b", "a\n\nb", "it's we'll 'tis 'd'd'd", "x" * 300, "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|endofte", "日本語 テキスト 123", "a b  c", "é" * 50, "²³ ½x", "\x0b\x1c \x85", "naïve—“q” €5 … ‰", "😀😀 z", "a\tb \tc\t d", "1234567 89a9", "!!?? ..  ", "\r\n\r\n x", "éa"]


def packed(text):
    return b"".join(i.to_bytes(4, "little") for i in LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert ENCODER.ids(text) == packed(text)


def test_null_and_the_fast_way_is_on():
    assert ENCODER.ids(None) == b"" and ENCODER.ranks is not None


def test_random_mixes_whole_and_spliced():
    random.seed(5)
    for _ in range(300):
        text = "".join(random.choice([*ODD[:-6], "word ", "and the ", "über", ".\n", "   ", " 12"]) for _ in range(random.randint(1, 60)))
        want = packed(text)
        assert ENCODER.short(text) == want
        for size, overlap in ((64, 40), (100, 50), (200, 64)):
            assert b"".join(bpe.spliced(text, ENCODER.chunk, size, overlap)) == want


def test_huge_words_widen_the_overlap():
    text = "ab " * 50 + "q" * 5000 + " tail " + " " * 700 + "end" * 400 + " x" * 200
    for chars in (text, text + "日本" * 300 + " 語" * 100):
        assert b"".join(bpe.spliced(chars, ENCODER.chunk, 256, 64)) == packed(chars)


def test_long_documents_take_the_chunked_way():
    text = "The quick brown fox's den. " * 9000
    assert len(text) > bpe.CHUNK_CHARS and ENCODER.ids(text) == packed(text)

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meterbook.llm.token_count import counted, spliceable

FILE = public_tokenizers.path("byte_bpe_50k.json")
SPECIAL = "<|endoftext|>"


def texts():
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\n\n ", "word", "it's", "123", "é", "日本", "😀", SPECIAL, "<|endof", "!!", "don't", "\t", "a" * 30]
    out = ["".join(rng.choice(bits) for _ in range(n)) for n in (0, 1, 5, 60, 300, 300, 300, 1000, 3000)]
    return out + [" " * 700, "x" * 900, "the cat. " * 200, SPECIAL * 80, "a " * 400 + "b" * 500, "\n" * 300 + "end"]


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (50, 33), (200, 100), (1 << 16, 1 << 10)])
def test_spliced_counts_equal_the_library(spark, chunk, overlap):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(99, None, None), (99, None, None), (8, texts()[8], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, uid string")
    got = sorted((r.doc_id, r.text or "", r.n_tokens) for r in counted(df, FILE, chunk, overlap).collect())
    tok = Tokenizer.from_file(FILE)
    assert got == sorted((i, t or "", len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)


def test_other_tokenizers_and_empty_tables(spark):
    other = public_tokenizers.path("word_bpe_49k.json")
    assert spliceable(FILE) and not spliceable(other)
    df = spark.createDataFrame([(1, "Hello there " * 50)], "doc_id bigint, text string")
    want = len(Tokenizer.from_file(other).encode("Hello there " * 50, add_special_tokens=False).ids)
    assert counted(df, other, 64, 16).first().n_tokens == want
    assert counted(df.limit(0), FILE).collect() == []


def test_a_column_of_the_same_name_is_replaced(spark):
    df = spark.createDataFrame([(1, "one two", 9), (2, "a " * 200, 9)], "doc_id bigint, text string, n_tokens int")
    got = counted(df, FILE, 64, 16)
    assert got.columns.count("n_tokens") == 1 and sorted(r.n_tokens for r in got.collect())[0] == 2

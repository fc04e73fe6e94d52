"""Token counts of texts of any length by overlap resynchronisation.

A text of up to ``chunk`` characters is encoded whole. A longer one is cut into chunks that
overlap; every chunk is a row of its own and is encoded with offsets, so one huge document
spreads over the cluster.

Why splicing is exact. The tokenizer first splits text into pre-tokens with a pattern that
reads left to right and keeps no memory across a match, and merges never cross a pre-token.
If the chunk before is in step with the whole text, its pre-token starts are those of the whole
text, except for the last few that the cut may have disturbed: those that end, or look ahead,
within ``guard`` characters of the cut, and the one before them. If the next chunk has a
pre-token start at one of the remaining positions, both read the same text from the same
position on, and stay equal. That common start is the splice: tokens before it count from the
left chunk, tokens from it on count from the right one. The first chunk is in step by itself,
so all are by induction. The guard is longer than every added token, so a special string that
the cut splits lies inside it.

Where two chunks have no common start (say, one pre-token longer than the overlap), chunk and
overlap of that document are doubled and it is encoded again, at last as one piece.

Supported are tokenizer files with a byte-level or pattern split before merging and no
normaliser; others are encoded whole. Special strings in a text are handled as the library does
by default; no begin, end or other added token is counted.

Defined cases: null and empty texts have no tokens; rows that repeat are counted each; other
columns pass through ``counted``, but for one called ``n_tokens``, which is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterbook.session import Staging

CHUNK = 1 << 16
OVERLAP = 1 << 10


@cache
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@cache
def _profile(path: str) -> tuple[bool, int]:
    """Can texts be spliced, and the guard before a cut."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    exact = not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex")
    exact = exact and not split.get("add_prefix_space")
    longest = max((len(t["content"]) for t in spec.get("added_tokens", [])), default=0)
    return bool(exact), longest + 2


def spliceable(path: str) -> bool:
    return _profile(path)[0]


def _starts(encoding) -> tuple[np.ndarray, np.ndarray]:
    """Character at which each pre-token starts, and the number of tokens before it.

    A pre-token is a run of tokens with one word number; an added token has none and is a run
    of its own.
    """
    words = np.array([-1 if w is None else w for w in encoding.word_ids], np.int64)
    begin = np.array([a for a, _ in encoding.offsets], np.int64)
    first = np.ones(len(words), bool)
    first[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
    at = np.flatnonzero(first)
    return begin[at], at


def chunks_of(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Character spans; each but the last reaches ``overlap`` into the next."""
    return [(a, min(length, a + chunk + overlap)) for a in range(0, max(length - overlap, 1), chunk)]


def encode_chunk(path: str, text: str, first: bool, last: bool, overlap: int):
    """Token count, and the pre-token starts in the overlaps at both ends.

    ``head`` and ``tail`` are ``(characters from the overlap's begin, tokens before)``.
    """
    encoding = _tokenizer(path).encode(text, add_special_tokens=False)
    starts, before = _starts(encoding)
    head = np.zeros((2, 0), np.int64)
    tail = head
    if not first:
        keep = starts < overlap
        head = np.stack([starts[keep], before[keep]])
    if not last:
        # a start is settled if the pre-token after it ends well before the cut
        settled = np.zeros(len(starts), bool)
        settled[:-2] = starts[2:] <= len(text) - _profile(path)[1]
        keep = settled & (starts >= len(text) - overlap)
        tail = np.stack([starts[keep] - (len(text) - overlap), before[keep]])
    return len(encoding.ids), head, tail


def _short_counts(path: str):
    @F.arrow_udf("bigint")
    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = _tokenizer(path)
        for column in columns:
            texts, n = column.fill_null("").to_pylist(), []
            for k in range(0, len(texts), 64):
                encoded = tokenizer.encode_batch_fast(texts[k : k + 64], add_special_tokens=False)
                n += [len(e.ids) for e in encoded]
            yield pa.array(n, pa.int64())

    return count


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(*(c.to_pylist() for c in batch.columns)):
                spans = chunks_of(len(text), chunk, overlap)
                for k in range(0, len(spans), 64):
                    part = spans[k : k + 64]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "uid": pa.array([uid] * len(part), pa.int64()),
                            "k": pa.array(range(k, k + len(part)), pa.int64()),
                            "last": pa.array([a == spans[-1][0] for a, _ in part]),
                            "part": pa.array([text[a:b] for a, b in part], pa.string()),
                        }
                    )

    return run


def _encode(path: str, overlap: int):
    schema = "uid bigint, pair bigint, side int, n bigint, at array<bigint>, before array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uid, k, last, part in zip(*(c.to_pylist() for c in batch.columns)):
                n, head, tail = encode_chunk(path, part, k == 0, last, overlap)
                # side 0: what the left chunk of splice k says, side 1: the right one of splice k-1
                rows.append((uid, k, 0, n, tail[0].tolist(), tail[1].tolist()))
                if k:
                    rows.append((uid, k - 1, 1, 0, head[0].tolist(), head[1].tolist()))
            lists = pa.list_(pa.int64())
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), lists, lists]
            names = ["uid", "pair", "side", "n", "at", "before"]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run, schema


def _spliced(encoded: DataFrame) -> DataFrame:
    """``uid, n_tokens, failed``: totals, less what two chunks count twice."""
    left = encoded.where("side = 0").select("uid", "pair", "n", "at", "before")
    right = encoded.where("side = 1").select(
        "uid", "pair", F.col("at").alias("r_at"), F.col("before").alias("r_before")
    )
    both = left.join(right, ["uid", "pair"], "left")
    common = F.array_min(F.array_intersect("at", "r_at"))
    twice = (
        F.col("n")
        - F.get("before", F.array_position("at", common).cast("int") - 1)
        + F.get("r_before", F.array_position("r_at", common).cast("int") - 1)
    )
    has_next = F.col("r_at").isNotNull()
    return both.groupBy("uid").agg(
        F.sum(F.col("n") - F.when(has_next, F.coalesce(twice, F.lit(0))).otherwise(0)).alias("n_tokens"),
        F.max(F.coalesce(has_next & common.isNull(), F.lit(False))).alias("failed"),
    )


def counted(
    docs: DataFrame, tokenizer_file: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``docs`` with ``n_tokens``; ``tokenizer_file`` must be readable on every executor."""
    docs = docs.drop("n_tokens")
    length = F.length(F.coalesce("text", F.lit("")))
    count = _short_counts(tokenizer_file)
    if not spliceable(tokenizer_file):
        return docs.withColumn("n_tokens", count("text"))
    short = docs.where(length <= chunk + overlap).withColumn("n_tokens", count("text"))

    staging = Staging(docs.sparkSession, "token-count")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    huge = staging.put(
        docs.where(length > chunk + overlap).select(
            F.monotonically_increasing_id().alias("uid"), row, docs["text"].alias("body")
        ),
        "huge",
    )
    todo, results = huge.select("uid", "body"), []
    while True:
        encode, schema = _encode(tokenizer_file, overlap)
        parts = todo.mapInArrow(_cut(chunk, overlap), "uid bigint, k bigint, last boolean, part string")
        encoded = staging.put(parts.repartition("uid", "k").mapInArrow(encode, schema), "encoded")
        totals = staging.put(_spliced(encoded), "totals")
        results.append(totals.where("NOT failed").select("uid", "n_tokens"))
        failed = totals.where("failed").select("uid")
        if failed.isEmpty():
            break
        todo = huge.join(failed, "uid", "left_semi").select("uid", "body")
        chunk, overlap = 2 * chunk, 2 * overlap
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    spliced = huge.join(found, "uid").select("row.*", "n_tokens")
    return short.unionByName(spliced)

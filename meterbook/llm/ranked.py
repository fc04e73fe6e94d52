"""Ranked lexical search with exact scores, by NRA over impact-sorted postings.

Terms are maximal runs of letters a-z, digits and characters beyond ASCII, with A-Z lowered. A
document scores ``sum of weight * impact`` over a query's distinct terms, in whole numbers
(``impacts``, ``weight``).

Two passes. The first reads every text once and stages, per document, its number of terms and the
postings of the terms that some query has; the corpus counts (documents, terms, documents per term)
are aggregates of that table. The second deals the staged rows into shards of ``SHARD_POSTINGS``
postings, each a slice of one task's rows, so no text, posting or score is shuffled, and searches a
shard for all queries. Shards return their ``k`` best per query and Spark ranks those, at first
within salts, so that a query with results from any number of tasks has no single task for them.

NRA (no random access). A shard's postings are sorted by term and falling impact. For a query the
lists of its terms are read in parallel from the top, deeper by ``GROWTH`` each round. A document
has a lower bound, what was read for it, and an upper bound, which adds the last impact read of
every list where it has not been met. Documents whose upper bound is below the k-th lower bound, or
below the k-th score of the task's earlier shards, are dropped for good. Reading goes on until
lower and upper bound are equal for every document left: then membership, ties and scores are
final. Documents that could still tie are kept, since ids decide among equal scores.

Queries are taken in blocks of ``BLOCK_TERMS`` distinct terms, one pass each; the driver and every
worker hold the terms of one block.

Defined cases: null texts and texts without terms are no documents and score nothing; null queries
and queries without known terms have no result; repeated rows are documents of their own and
repeated queries are answered each; equal scores are ordered by ascending id, null last; texts of
any length are read whole, in slices; extra columns are not carried; an empty table on either side
gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meterbook.llm.words import text_buffers
from meterbook.session import Staging

SCALE = 1_000_000_000
BLOCK_TERMS = 200_000
SHARD_POSTINGS = 1_000_000
FIRST_DEPTH = 128
GROWTH = 4
_SLICE_BYTES = 1 << 20
_SALTS = 64

_LOWERED = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, slice by slice."""
    text = text.translate(_LOWERED)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + _SLICE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def weight(documents: int, containing: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * containing + 1)))


def impacts(counts: np.ndarray, lengths: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """What a term adds per unit of weight to a document of ``lengths`` terms that has it so often."""
    if int(lengths.max(initial=0)) * 90 * documents >= 1 << 62:
        lengths = lengths.astype(object)
    m = 10 + (90 * lengths * documents) // all_terms
    return ((SCALE * counts) // (1000 * counts + 8 * m)).astype(np.int64)


def _postings(vocabulary):
    """``doc_id, n, terms, counts`` of rows with at least one term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        ints = pa.list_(pa.int32())
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            at, n, terms, counts = [], [], [], []
            for row in range(batch.num_rows):
                size, found = 0, Counter()
                for part in terms_of(data[offsets[row] : offsets[row + 1]].tobytes()):
                    size += len(part)
                    found.update(map(number, part))
                if size:
                    found.pop(None, None)
                    at.append(row)
                    n.append(size)
                    terms.append(list(found))
                    counts.append(list(found.values()))
            arrays = [
                batch.column(0).take(pa.array(at, pa.int64())),
                pa.array(n, pa.int64()),
                pa.array(terms, ints),
                pa.array(counts, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "terms", "counts"])

    return run


class Shard:
    """Impact-sorted postings of some documents, which are numbered by ascending id."""

    def __init__(self, ids: list, lengths, bounds, terms, counts, documents: int, all_terms: int):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
        self.ids = [ids[i] for i in order]
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids), dtype=np.int32)
        sizes = np.diff(bounds)
        impact = impacts(counts, np.repeat(lengths, sizes), documents, all_terms)
        by_list = np.argsort((terms.astype(np.int64) << 32) - impact, kind="stable")
        terms = terms[by_list]
        self.docs = np.repeat(place, sizes)[by_list]
        self.impact = impact[by_list]
        self.first = np.flatnonzero(np.diff(terms, prepend=-1))
        self.last = np.append(self.first[1:], len(terms))
        self.list_of = {int(t): k for k, t in enumerate(terms[self.first])}

    def best(self, query: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the ``k`` best of ``(term, weight)``, those below ``least`` left out."""
        lists = [(self.list_of[t], w) for t, w in query if w > 0 and t in self.list_of]
        first = np.array([self.first[j] for j, _ in lists], np.int64)
        last = np.array([self.last[j] for j, _ in lists], np.int64)
        weights = np.array([w for _, w in lists], np.int64)
        lower = np.zeros(len(self.ids), np.int64)
        alive = np.ones(len(self.ids), bool)
        docs, of_list = np.zeros(0, np.int32), np.zeros(0, np.int32)
        at, depth = first.copy(), FIRST_DEPTH
        frontier = weights * self.impact[first]  # nothing in a list adds more than its top
        while True:
            open_ = np.full(len(self.ids), frontier.sum())
            np.subtract.at(open_, docs, frontier[of_list])
            bar = max(1, least)
            if len(lower) >= k:
                bar = max(bar, int(np.partition(lower, len(lower) - k)[len(lower) - k]))
            alive &= lower + open_ >= bar
            if not open_[alive].any():
                break
            # a list in which all documents left have been met is read no further
            met = np.bincount(of_list[alive[docs]], minlength=len(lists))
            end = np.where(met < alive.sum(), np.minimum(at + depth, last), at)
            spans = [np.arange(a, b) for a, b in zip(at, end)]
            read = np.concatenate(spans)
            which = np.repeat(np.arange(len(lists), dtype=np.int32), end - at)
            near = alive[self.docs[read]]
            read, which = read[near], which[near]
            np.add.at(lower, self.docs[read], weights[which] * self.impact[read])
            keep = alive[docs]
            docs = np.concatenate([docs[keep], self.docs[read]])
            of_list = np.concatenate([of_list[keep], which])
            frontier = np.where(end == last, 0, np.where(end > at, weights * self.impact[end - 1], frontier))
            at, depth = end, depth * GROWTH
        found = np.flatnonzero(alive & (lower > 0))
        found = found[np.lexsort((found, -lower[found]))][:k]
        return found, lower[found]


def _shards(batches: Iterator[pa.RecordBatch], documents: int, all_terms: int) -> Iterator[Shard]:
    ids, parts, held = [], [], 0

    def shard() -> Shard:
        lengths, sizes, terms, counts = (np.concatenate(c) for c in zip(*parts))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return Shard(ids, lengths, bounds, terms, counts, documents, all_terms)

    for batch in batches:
        terms, counts = (batch.column(c) for c in (2, 3))
        ids += batch.column(0).to_pylist()
        sizes = np.diff(terms.offsets.to_numpy())
        lengths = batch.column(1).to_numpy(zero_copy_only=False)
        parts.append((lengths, sizes, terms.flatten().to_numpy(), counts.flatten().to_numpy()))
        held += len(terms.flatten())
        if held >= SHARD_POSTINGS:
            yield shard()
            ids, parts, held = [], [], 0
    if parts:
        yield shard()


def _search(queries, documents: int, all_terms: int, k: int, kinds):
    """``query, item_id, doc_id, score``: the best ``k`` of each query among a task's rows."""

    def order(hit):
        score, doc = hit
        return -score, doc is None, doc if doc is not None else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for shard in _shards(batches, documents, all_terms):
            for q, (_, terms) in enumerate(queries.value):
                hits = best.get(q, [])
                least = hits[-1][0] if len(hits) == k else 0
                docs, scores = shard.best(terms, k, least)
                if len(docs):
                    hits = hits + [(s, shard.ids[d]) for d, s in zip(docs.tolist(), scores.tolist())]
                    best[q] = sorted(hits, key=order)[:k]
        rows = [(q, queries.value[q][0], doc, s) for q, hits in best.items() for s, doc in hits]
        columns = list(zip(*rows)) or [()] * 4
        types = [pa.int64(), *kinds, pa.int64()]
        names = ["query", "item_id", "doc_id", "score"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """``(item_id, terms)`` of blocks of queries; the driver holds one block at a time."""
    rows, known = [], set()
    for r in items.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        terms = {t for part in terms_of(r.text.encode()) for t in part}
        if terms:
            rows.append((r.item_id, terms))
            known |= terms
        if len(known) >= BLOCK_TERMS:
            yield rows
            rows, known = [], set()
    if rows:
        yield rows


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query with their rank; at first within salts."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.spark_partition_id() % _SALTS)
    for keys in (["query", "salt"], ["query"]):
        window = Window.partitionBy(*keys).orderBy(*order)
        salted = salted.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    return salted.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item."""
    spark = docs.sparkSession
    staging = Staging(spark, "ranked")
    ids = [items.schema["item_id"].dataType, docs.schema["doc_id"].dataType]
    kinds = [to_arrow_type(t) for t in ids]
    schema = f"query bigint, item_id {ids[0].simpleString()}, doc_id {ids[1].simpleString()}, score bigint"
    result = spark.createDataFrame([], schema)
    result = result.withColumn("rank", F.lit(0)).select("item_id", "rank", "doc_id", "score")
    for rows in _blocks(items):
        numbers = {t: k for k, t in enumerate(sorted(set().union(*(terms for _, terms in rows))))}
        vocabulary = spark.sparkContext.broadcast(numbers)  # at most BLOCK_TERMS and the terms of one item
        table = docs.select("doc_id", "text").mapInArrow(
            _postings(vocabulary), f"doc_id {ids[1].simpleString()}, n bigint, terms array<int>, counts array<bigint>"
        )
        postings = staging.put(table, "postings")
        corpus = postings.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
        if not corpus.documents:
            continue
        # one row per term of the block
        containing = postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
        weights = {r.t: weight(corpus.documents, r["count"]) for r in containing}
        known = [(i, [(numbers[t], weights[numbers[t]]) for t in sorted(ts) if numbers[t] in weights]) for i, ts in rows]
        queries = spark.sparkContext.broadcast([q for q in known if q[1]])
        found = postings.mapInArrow(_search(queries, corpus.documents, corpus.terms, k, kinds), schema)
        result = result.unionByName(_ranked(found, k))
    return result

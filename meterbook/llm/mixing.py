"""Mixing sources to target token weights by entropy balancing.

Every source gets a target number of words. Document rates are those closest to one copy each
in relative entropy, with at most ``CAP`` copies, that meet the targets: the solution is an
exponential tilt, ``rate = min(CAP, exp(l * size))``, with one multiplier ``l`` per source (sizes
in units of the source's mean). The multipliers solve the convex dual. Each Newton iteration is
one Spark aggregation over the histogram of (source, size) and yields the dual's gradient and
curvature; a bracket around each root replaces steps that leave it. A source whose target is its
cap has every rate at ``CAP``.

Rates are then rounded to whole copies with error diffusion: documents of a source are dealt into
buckets by hash, each bucket goes from the largest to the smallest document and rounds up or down
so that the error carried along stays least. Small documents settle what large ones leave, so a
bucket ends within about one small document of its target. Buckets hold ``BUCKET_ROWS`` rows on
average and are streamed in order; a source may hold any share of the rows.

Rates are fixed-point numbers and their sums exact, so reruns agree to the copy.

The driver holds one row per source. Their number is metadata of the mix; above ``MAX_SOURCES``
an error says so, as targets for that many sources are no mix by source.

Defined cases: a null source is a source of its own, last in order; a null text has size 0;
documents of size 0 take 0 words; sources without words have target 0; rows that repeat are mixed
each; ``mix`` carries other columns, but for one called ``copies``, which is replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meterbook.session import Staging

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
CAP = 2
BUCKET_ROWS = 4_000
MAX_SOURCES = 100_000
_ONE = 1 << 30  # fixed-point rate of one copy
_NEWTON_STEPS = 60  # brackets that are still open after these are halved until they close


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def targets(sizes: Sequence[int], weights=WEIGHTS, share=SHARE, cap: int = CAP) -> list[Fraction]:
    """Words per source: ``share`` of all, dealt by weight, what exceeds a cap dealt again."""
    open_, result = set(range(len(sizes))), [Fraction(0)] * len(sizes)
    left = share * sum(sizes)
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        full = {i for i in open_ if left * weights[i % len(weights)] > cap * sizes[i] * total}
        for i in full or open_:
            result[i] = Fraction(cap * sizes[i]) if full else left * weights[i % len(weights)] / total
        if not full:
            break
        open_ -= full
        left -= sum(result[i] for i in full)
    return result


class _Root:
    """Multiplier of one source, with a bracket."""

    def __init__(self, size: int, docs: int, target: Fraction, cap: int):
        self.unit = max(size / max(docs, 1), 1.0)  # mean size
        self.target = float(target)
        self.value, self.low, self.high = 0.0, -math.inf, math.inf
        self.fixed = _ONE * cap if target >= cap * size else 0 if target <= 0 else None
        self.done = self.fixed is not None

    def step(self, words: float, slope: float, halve: bool = False) -> None:
        """Move on, given the words taken at ``value`` and their derivative."""
        gap = words - self.target
        if abs(gap) <= max(0.25, 1e-9 * self.target):
            self.done = True
            return
        if gap > 0:
            self.high = self.value
        else:
            self.low = self.value
        new = self.value - gap / slope if slope > 0 and not halve else math.nan
        if not self.low < new < self.high:
            if math.isinf(self.low):
                new = min(2 * self.value, -1.0)
            elif math.isinf(self.high):
                new = max(2 * self.value, 1.0)
            else:
                new = (self.low + self.high) / 2
        self.done = self.done or new == self.value
        self.value = new


def _rate(multiplier: Column, unit: Column, size: Column, fixed: Column, cap: int) -> Column:
    tilt = F.least(multiplier * size / unit, F.lit(math.log(cap)))
    return F.coalesce(fixed, F.least(F.rint(F.exp(tilt) * _ONE).cast("bigint"), F.lit(cap * _ONE)))


def _state(spark, roots: list[_Root], keep) -> DataFrame:
    rows = [(k, r.value, r.unit, r.fixed) for k, r in enumerate(roots) if keep(r)]
    return spark.createDataFrame(rows, "k int, multiplier double, unit double, fixed bigint")


def _solve(histogram: DataFrame, roots: list[_Root], cap: int) -> None:
    """Newton iterations on the dual; each is one aggregation over the histogram.

    Every root is found: a bracket that is halved closes within the digits of a double.
    """
    spark = histogram.sparkSession
    steps = itertools.count()
    while not all(r.done for r in roots):
        halve = next(steps) >= _NEWTON_STEPS
        # one row per source, at most MAX_SOURCES
        state = F.broadcast(_state(spark, roots, lambda r: not r.done))
        rate = _rate(F.col("multiplier"), F.col("unit"), F.col("size"), F.col("fixed"), cap)
        words = (F.col("docs") * F.col("size")).cast("decimal(19,0)")
        tilted = words * F.col("rate").cast("decimal(11,0)")
        bent = F.when(F.col("rate") < cap * _ONE, tilted.cast("double") * F.col("size") / F.col("unit"))
        sums = (
            histogram.join(state, "k")
            .withColumn("rate", rate)
            .groupBy("k")
            .agg(F.sum(tilted).alias("words"), F.sum(bent.cast("decimal(38,0)")).alias("slope"))
            .collect()
        )
        for r in sums:
            roots[r.k].step(float(r.words) / _ONE, float(r.slope or 0) / _ONE, halve)


def _rounded(rated: DataFrame) -> DataFrame:
    """Copies per row; input ``k, bucket, size, rate`` and the id, in error-diffusion order."""
    key = rated.schema["doc_id"].dataType
    names = ["doc_id", "k", "size", "rate", "copies"]
    kinds = [to_arrow_type(key), pa.int32(), pa.int64(), pa.int64(), pa.int32()]

    def diffuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, error = None, 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            copies = []
            for k, bucket, size, rate in zip(*columns[1:5]):
                if (k, bucket) != group:
                    group, error = (k, bucket), 0
                low, part = divmod(rate, _ONE)
                error += part * size
                up = part > 0 and 2 * error >= size * _ONE
                error -= up * size * _ONE
                copies.append(low + up)
            columns = [columns[0], columns[1], columns[3], columns[4], copies]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    order = ["k", "bucket", F.desc("size"), F.xxhash64("doc_id"), "doc_id"]
    streamed = rated.repartition("k", "bucket").sortWithinPartitions(*order)
    schema = f"doc_id {key.simpleString()}, k int, size bigint, rate bigint, copies int"
    return streamed.select("doc_id", "k", "bucket", "size", "rate").mapInArrow(diffuse, schema)


def mixed(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP) -> DataFrame:
    """``doc_id, source, size, source_size, target, rate, copies, taken`` for every row."""
    spark = docs.sparkSession
    staging = Staging(spark, "mixing")
    sizes = staging.put(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    rows = totals.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    goals = targets([r.words for r in rows], weights, share, cap)
    roots = [_Root(r.words, r.docs, t, cap) for r, t in zip(rows, goals)]

    # one row per source, at most MAX_SOURCES
    sources = F.broadcast(
        spark.createDataFrame(
            [(k, r.source, r.words, float(t), -(-r.docs // BUCKET_ROWS)) for k, (r, t) in enumerate(zip(rows, goals))],
            "k int, name string, source_size bigint, target double, buckets bigint",
        )
    )
    numbered = sizes.join(sources, F.col("source").eqNullSafe(F.col("name")))
    histogram = staging.put(numbered.groupBy("k", "size").agg(F.count(F.lit(1)).alias("docs")), "histogram")
    _solve(histogram, roots, cap)

    final = F.broadcast(_state(spark, roots, lambda r: True))  # one row per source
    rate = _rate(F.col("multiplier"), F.col("unit"), F.col("size"), F.col("fixed"), cap)
    rated = numbered.join(final, "k").select(
        "doc_id", "k", F.pmod(F.xxhash64("doc_id"), "buckets").alias("bucket"), "size", rate.alias("rate")
    )
    return (
        _rounded(rated)
        .join(sources, "k")
        .select(
            "doc_id",
            F.col("name").alias("source"),
            "size",
            "source_size",
            "target",
            (F.col("rate") / _ONE).alias("rate"),
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``copies``: how often it takes them."""
    docs = docs.drop("copies")
    staging = Staging(docs.sparkSession, "mix")
    plan = staging.put(mixed(docs, weights, share, cap).select("doc_id", "source", "size", "copies"), "plan")
    repeats = plan.groupBy("doc_id", "source", "size").agg(
        F.sort_array(F.collect_list("copies"), asc=False).alias("each")
    )
    return _attached(docs, repeats)


def _attached(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """Rows with equal id, source and size share their copies out, first come first served."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    keyed = docs.select(
        row, docs["doc_id"].alias("i"), docs["source"].alias("s"), word_count(docs["text"]).alias("n")
    )
    same = (
        F.col("i").eqNullSafe(F.col("doc_id"))
        & F.col("s").eqNullSafe(F.col("source"))
        & (F.col("n") == F.col("size"))
    )
    single = keyed.join(repeats.where("size(each) = 1 AND each[0] > 0"), same)
    several = keyed.join(repeats.where("size(each) > 1 AND each[0] > 0"), same).withColumn(
        "at", F.row_number().over(Window.partitionBy("i", "s", "n").orderBy(F.xxhash64("row")))
    )
    out = single.select("row.*", F.col("each")[0].alias("copies"))
    more = several.withColumn("copies", F.get("each", F.col("at") - 1)).where("copies > 0")
    return out.unionByName(more.select("row.*", "copies"))

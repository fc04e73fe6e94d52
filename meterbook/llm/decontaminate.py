"""Benchmark decontamination by the q-gram lemma and banded alignment.

A benchmark item of ``m`` characters is found in a document if some stretch of the text is within
``k = floor(BUDGET * m)`` edits of the whole item. Both are compared with ASCII letters lowered
and every run of white space as one space.

Lemma. ``k`` edits spoil at most ``q * k`` of the item's ``m + 1 - q`` q-grams, and move what is
left by at most ``k`` diagonals. So the stretch shares at least ``t = m + 1 - q * (k + 1)``
q-grams with the item within ``k + 1`` neighbouring diagonals. Shared q-grams are counted in
overlapping bands of diagonals, twice as wide as their step, so that one band holds them all.
Bands with ``t`` hits or more are kept and verified by alignment within the band widened by ``k``.
Where ``t`` exceeds ``_KEPT``, as many of the item's grams that are most frequent among the items
are left out of the index; each lowers the count asked for by one, so nothing is missed.

Every item uses the largest of ``GRAM_SIZES`` that leaves it a count of ``_LEAST`` or more. Items
are put into blocks of at most ``BLOCK_CHARS`` characters; the index of a block is broadcast, and
every block passes over all documents, so any number of items works. Documents are read whole, in
overlapping slices, and never shuffle.

Items shorter than ``MIN_ITEM_CHARS`` leave the lemma little to count, and an edit makes another
word of them. They are found where a text has them unchanged, as whole words, by an automaton over
the block's short items (``Exact``).

Defined cases: null and empty texts match nothing; null items and items of white space alone are
nothing to find and are ignored; repeated items and repeated rows are reported each; a budget that
leaves an item without a gram it must share is an error; an empty table on either side gives no
match.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BUDGET = 0.1
GRAM_SIZES = (8, 5, 3)
MIN_ITEM_CHARS = 24
BLOCK_CHARS = 4_000_000
SLICE_CHARS = 400_000
_LEAST = 4
_KEPT = 24
_TABLE = 1 << 20
_RADIX = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points after normalisation, and where each was in the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[:1] = True
    out = points[keep]
    out[space[keep]] = 32
    upper = (out >= 65) & (out <= 90)
    out[upper] += 32
    return out, np.flatnonzero(keep)


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of every ``q`` consecutive characters, put together from halves."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done = None, 0
    part, size = points.astype(np.uint64), 1
    while True:
        if q & size:
            total = part[:n] if total is None else total * _power(size) + part[done : done + n]
            done += size
        if 2 * size > q:
            return total ^ (total >> np.uint64(31))
        part = part[:-size] * _power(size) + part[size:]
        size *= 2


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_RADIX), n, 1 << 64))


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> int | None:
    """Fewest edits that turn ``item`` into a stretch of ``text`` on diagonals low to high.

    Row ``i`` of the band holds the cells at text position ``i + d``; a stretch may begin and
    end anywhere in the band. None above ``budget``.
    """
    d = np.arange(low, high + 1)
    ramp = np.arange(len(d))
    far = np.int64(len(item) + len(d) + 1)
    row = np.where((d >= 0) & (d <= len(text)), 0, far)
    for i, ch in enumerate(item, 1):
        at = d + i  # characters of text used
        inside = (at >= 1) & (at <= len(text))
        same = np.zeros(len(d), bool)
        same[inside] = text[at[inside] - 1] == ch
        new = np.where(inside, row + ~same, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new[(at < 0) | (at > len(text))] = far
        row = np.minimum.accumulate(new - ramp) + ramp
        if row.min() > budget:
            return None
    best = int(row.min())
    return best if best <= budget else None


class Index:
    """Inverted lists of the items' q-grams, of one gram size."""

    def __init__(self, q: int, items: list[tuple[object, np.ndarray]], budget: float):
        self.q, self.items = q, items
        self.allowed = np.array([int(budget * len(x)) for _, x in items])
        self.step = int(self.allowed.max()) + 1
        hashes = [grams(x, q) for _, x in items]
        every, counts = np.unique(np.concatenate(hashes), return_counts=True)
        need, keys, owners, places = [], [], [], []
        for n, h in enumerate(hashes):
            least = len(h) - q * int(self.allowed[n])
            frequent = np.argsort(-counts[np.searchsorted(every, h)], kind="stable")
            dropped = max(0, least - _KEPT)
            kept = np.sort(frequent[dropped:])
            need.append(least - dropped)
            keys.append(h[kept])
            owners.append(np.full(len(kept), n))
            places.append(kept)
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.first = np.append(self.first, len(keys))
        self.owners = np.concatenate(owners)[order]
        self.places = np.concatenate(places)[order]
        self.need = np.array(need)
        self.table = np.zeros(_TABLE, bool)
        self.table[self.keys & np.uint64(_TABLE - 1)] = True
        self.longest = max(len(x) for _, x in items)
        self.reach = max(len(x) for _, x in items) + 4 * self.step + q

    def bands(self, points: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``(item, first diagonal, first and last hit)`` of bands with enough hits."""
        h = grams(points, self.q)
        at = np.flatnonzero(self.table[h & np.uint64(_TABLE - 1)])
        slot = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        real = self.keys[slot] == h[at]
        at, slot = at[real], slot[real]
        size = self.first[slot + 1] - self.first[slot]
        total = int(size.sum())
        if not total:
            return []
        position = np.repeat(at, size)
        start = np.repeat(self.first[slot] - np.append(0, np.cumsum(size)[:-1]), size)
        entry = start + np.arange(total)
        owner = self.owners[entry]
        place = self.places[entry]
        band = (position - place) // self.step
        least = int(band.min()) - 1
        width = int(band.max()) - least + 1
        lane = owner * width + band - least
        # a first count by band and the one before drops most hits unsorted
        total = np.bincount(lane, minlength=width * len(self.items)) if width < 50_000 else None
        if total is not None:
            total[:-1] += total[1:].copy()
            near = np.maximum(total[lane], total[np.maximum(lane - 1, 0)]) >= self.need[owner]
            owner, position, place, lane = owner[near], position[near], place[near], lane[near]
        key = np.concatenate([lane, lane - 1])
        # a gram of the item counts once in a band
        gram = key * self.longest + np.concatenate([place, place])
        gram, pick = np.unique(gram, return_index=True)
        key, begins, counts = np.unique(gram // self.longest, return_index=True, return_counts=True)
        position = np.concatenate([position, position])[pick]
        out = []
        for f in np.flatnonzero((key >= 0) & (counts >= self.need[np.minimum(key // width, len(self.need) - 1)])):
            hits = position[begins[f] : begins[f] + counts[f]]
            diagonal = (int(key[f] % width) + least) * self.step
            out.append((int(key[f] // width), diagonal, int(hits.min()), int(hits.max()) + self.q))
        return out

    def find(self, points: np.ndarray) -> Iterator[tuple[object, int, int, int]]:
        """``(item id, edits, first, end)`` of verified bands; one stretch may come twice."""
        for n, diagonal, first, end in self.bands(points):
            item, k = self.items[n][1], int(self.allowed[n])
            edits = aligned(item, points, diagonal - k, diagonal + 2 * self.step - 1 + k, k)
            if edits is not None:
                yield n, edits, first, end


class Exact:
    """Items that count unchanged, where no letter or digit goes on at either end."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.items = items

    @cached_property
    def _automaton(self) -> ahocorasick.Automaton:
        owners: dict[str, list[int]] = {}
        for n, (_, points) in enumerate(self.items):
            owners.setdefault(_string(points), []).append(n)
        automaton = ahocorasick.Automaton()
        for item, numbers in owners.items():
            automaton.add_word(item, (len(item), numbers))
        automaton.make_automaton()
        return automaton

    def find(self, points: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        text = _string(points)
        for last, (length, numbers) in self._automaton.iter(text):
            first, end = last + 1 - length, last + 1
            inner = (text[first - 1 : first + 1] if first else "", text[last : end + 1] if end < len(text) else "")
            if not any(len(pair) == 2 and pair.isalnum() for pair in inner):
                yield from ((n, 0, first, end) for n in numbers)


def _string(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def matches_of(text: str, indexes: list[Index | Exact]) -> list[tuple[object, int, int, int]]:
    """Best match of each item: ``(item id, edits, first character, end)``."""
    out = []
    points, origin = normalised(text)
    for index in indexes:
        best: dict[int, tuple[int, int, int]] = {}
        exact = isinstance(index, Exact)
        step = max(len(points), 1) if exact else SLICE_CHARS
        for a in range(0, max(len(points), 1), step):
            part = points if exact else points[a : a + SLICE_CHARS + index.reach]
            for n, edits, first, end in index.find(part):
                found = (edits, int(origin[a + first]), int(origin[a + end - 1]) + 1)
                best[n] = min(best.get(n, found), found)
        out += [(index.items[n][0], *b) for n, b in sorted(best.items())]
    return out


def _blocks(benchmark: DataFrame, budget: float) -> Iterator[list[Index | Exact]]:
    """Indexes of blocks of items; the driver holds one block at a time."""

    def indexes(rows: list) -> list[Index | Exact]:
        of = {q: [r[:2] for r in rows if r[2] == q] for q in (None, *GRAM_SIZES)}
        return [Exact(items) if q is None else Index(q, items, budget) for q, items in of.items() if items]

    rows, size = [], 0
    for r in benchmark.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        points, _ = normalised(r.text.strip(" \t\n\v\f\r"))
        m = len(points)
        if not m:
            continue
        shared = {q: m + 1 - q * (int(budget * m) + 1) for q in GRAM_SIZES}
        gram = max((q for q in GRAM_SIZES if shared[q] >= _LEAST), default=GRAM_SIZES[-1])
        if m >= MIN_ITEM_CHARS and shared[gram] < 1:
            raise ValueError(f"with a budget of {budget} an item of {m} characters need not share a gram")
        rows.append((r.item_id, points, gram if m >= MIN_ITEM_CHARS else None))
        size += m
        if size >= BLOCK_CHARS:
            yield indexes(rows)
            rows, size = [], 0
    if rows:
        yield indexes(rows)


def matches(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``doc_id, item_id, edits, first_char, end_char``: one row per document and item found."""
    kinds = [docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType]
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, "
    schema += "edits int, first_char bigint, end_char bigint"
    arrow = [*map(to_arrow_type, kinds), pa.int32(), pa.int64(), pa.int64()]
    names = ["doc_id", "item_id", "edits", "first_char", "end_char"]
    spark = docs.sparkSession
    result = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, budget):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                rows = [(i, *m) for i, t in zip(ids, texts) for m in matches_of(t.as_py() or "", shared.value)]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, arrow)], names)

        result = result.unionByName(docs.select("doc_id", "text").mapInArrow(search, schema))
    return result


def decontaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their columns; nothing shuffles."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    left = docs.select(row, docs["text"].alias("text"))
    for block in _blocks(benchmark, budget):
        left = left.where(_clean(docs.sparkSession.sparkContext.broadcast(block))("text"))
    return left.select("row.*")


def _clean(shared):
    @F.arrow_udf("boolean")
    def clean(column: pa.Array) -> pa.Array:
        return pa.array([not matches_of(t.as_py() or "", shared.value) for t in column], pa.bool_())

    return clean

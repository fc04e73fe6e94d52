"""Exact similarity join of word shingle sets by T-occurrence search with DivideSkip.

Two texts link when ``100 * |A & B| >= percent * |A | B|``. All links are found; the result names
for every row the component it reaches by links.

1. Every text becomes its set of distinct ``k``-word shingles (64-bit hashes). Equal sets are one
   node, so copies of a text cost one row each and nothing more.
2. Links need an overlap of at least ``T = ceil(percent * n / 100)``. Shingles are put in one
   global order, rare ones first, by a count sketch of the whole corpus. Linked sets share at
   least ``MEET`` of their first ``n - T + MEET`` shingles, the short inverted lists. Only those
   are shuffled.
3. A list of up to ``LONG_LIST`` nodes names its pairs of fitting size, and pairs that meet in
   ``MEET`` lists stay. A longer list chains its members, by size, to the first of each run of
   fitting sizes instead. Either way linked nodes end in one connected group of candidates.
4. Each group is searched by itself. Its sets are indexed smallest first; every set is a query with
   threshold ``T`` against the sets before it. DivideSkip leaves the longest lists out, merges
   the short ones with a heap, keeps nodes met ``T - L`` times, and looks these up in the long
   lists by binary search. Nodes that are known to be connected are not compared again.
5. The links found, at most one per node and task, give the components.

A group of more than ``GROUP_NODES`` nodes is dealt into blocks; every two blocks meet in a task.
A task then holds two blocks, at any size of group.

Two different texts are taken for one node only if 64-bit hashes collide.

Defined cases: letters A-Z are lowered; a text with fewer than ``k`` words is one shingle; null,
empty and blank texts have the empty set and link with nothing; rows that repeat share a node;
null ids are reported, with the least non-null id of their component; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meterbook.llm import sketch, words
from meterbook.llm.components import components
from meterbook.session import Staging

#: Cells of the count sketch: 8 MiB on the driver and in each worker.
CELLS = 1 << 21
_CELL_BLOCK = 1 << 15
MEET = 3
LONG_LIST = 48
GROUP_NODES = 4_000


def set_id(shingles: np.ndarray) -> int:
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def required(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any set it links to."""
    return -(-percent * n // 100)


def overlap(n: int, m: int, percent: int) -> int:
    """Least overlap of linked sets of ``n`` and ``m``."""
    return -(-percent * (n + m) // (100 + percent))


def meetings(n: int, percent: int) -> int:
    return min(MEET, required(n, percent))


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, shingle set)`` for every row."""
    for first, hashes, bounds in words.hashed_words(column, lower=True):
        for i in range(len(bounds) - 1):
            yield first + i, words.shingle_set(hashes[bounds[i] : bounds[i + 1]], k)


def _cells(shingles: np.ndarray) -> np.ndarray:
    return ((shingles >> np.uint64(20)) & np.uint64(CELLS - 1)).astype(np.int64)


def _described(docs: DataFrame, k: int) -> DataFrame:
    """Rows ``doc_id, key, node, n``, and rows ``block, counts`` with each task's part of the sketch."""
    kind = docs.schema["doc_id"].dataType
    kinds = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["doc_id", "key", "node", "n", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, held = np.zeros(CELLS, np.uint32), [], 0
        for batch in batches:
            nodes, sizes = [], []
            for _, shingles in _sets(batch.column(2), k):
                nodes.append(set_id(shingles))
                sizes.append(len(shingles))
                waiting.append(_cells(shingles))
                held += len(shingles)
                if held > CELLS:
                    total += np.bincount(np.concatenate(waiting), minlength=CELLS).astype(np.uint32)
                    waiting, held = [], 0
            made = [nodes, sizes, [None] * len(nodes), [None] * len(nodes)]
            columns = [pa.array(c, t) for c, t in zip(made, kinds[2:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kinds[0]), batch.column(1), *columns], names)
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=CELLS).astype(np.uint32)
        for b in range(0, CELLS, _CELL_BLOCK):
            part = total[b : b + _CELL_BLOCK]
            if part.any():
                row = [[None], [None], [None], [None], [b // _CELL_BLOCK], [zlib.compress(part.tobytes(), 1)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds)], names)

    schema = f"doc_id {kind.simpleString()}, key bigint, node bigint, n int, block int, counts binary"
    return docs.select("doc_id", "key", "text").mapInArrow(run, schema)


def _sketch(parts: DataFrame) -> np.ndarray:
    """Sum of the tasks' parts, block by block; blocks are merged as they stream."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None

        def row() -> pa.RecordBatch:
            data = zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary())], ["block", "counts"])

        for batch in batches:
            for b, raw in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.uint64)
                if b == block:
                    total += part
                    continue
                if block is not None:
                    yield row()
                block, total = b, part
        if block is not None:
            yield row()

    sorted_parts = parts.select("block", "counts").repartition("block").sortWithinPartitions("block")
    out = np.zeros(CELLS, np.uint32)
    for r in sorted_parts.mapInArrow(merge, "block int, counts binary").collect():
        part = np.frombuffer(zlib.decompress(bytes(r.counts)), np.uint32)
        out[r.block * _CELL_BLOCK : r.block * _CELL_BLOCK + len(part)] = part
    return out


def _postings(docs: DataFrame, counts, k: int, percent: int) -> DataFrame:
    """``shingle, node, n`` for the first shingles of every node, rare ones first."""
    least = math.ceil(percent / (100 - percent)) if percent < 100 else 1 << 62  # smaller sets link to no other set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            shingles, nodes, sizes = [], [], []
            for _, s in _sets(batch.column(0), k):
                n = len(s)
                if n < least or (node := set_id(s)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                take = min(n, n - required(n, percent) + meetings(n, percent))
                order = np.argsort(counts.value[_cells(s)], kind="stable")[:take]
                shingles.append(s[order])
                nodes.append(node)
                sizes.append(n)
            if nodes:
                each = [len(s) for s in shingles]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(shingles).view(np.int64)),
                        pa.array(np.repeat(np.array(nodes, np.int64), each)),
                        pa.array(np.repeat(np.array(sizes, np.int32), each)),
                    ],
                    ["shingle", "node", "n"],
                )

    return docs.select("text").mapInArrow(run, "shingle bigint, node bigint, n int")


class _List:
    """One inverted list as it streams by, sorted by size and node."""

    def __init__(self, percent: int, long_list: int):
        self.percent, self.long_list = percent, long_list
        self.members, self.count, self.first = [], 0, None

    def fits(self, small: int, large: int) -> bool:
        return 100 * small >= self.percent * large

    def add(self, n: int, node: int, out: list) -> None:
        if self.members and self.members[-1] == (n, node):
            return  # a copy from another task
        self.count += 1
        if self.count <= self.long_list:
            self.members.append((n, node))
            return
        if self.count == self.long_list + 1:
            for member in self.members:
                self.chain(*member, out)
        self.members = [(n, node)]
        self.chain(n, node, out)

    def chain(self, n: int, node: int, out: list) -> None:
        if self.first is None or not self.fits(self.first[1], n):
            self.first = (node, n)
        else:
            out.append((node, self.first[0], MEET, MEET))
            self.first = (self.first[0], n)

    def close(self, out: list) -> None:
        if not 2 <= self.count <= self.long_list:
            return
        for j, (large, b) in enumerate(self.members):
            need = meetings(large, self.percent)
            for small, a in self.members[:j]:
                if self.fits(small, large):
                    out.append((a, b, 1, min(need, meetings(small, self.percent))))


def _candidate_edges(postings: DataFrame, percent: int, long_list: int) -> DataFrame:
    """``a, b``: nodes that may link, or are chained by a long list."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = ["a", "b", "met", "need"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shingle = None, None
        for batch in batches:
            keys, nodes, sizes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            out: list = []
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            ends = np.append(starts[1:], len(keys))
            # lists of one member inside the batch need no look
            look = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(keys)))
            for a, b in zip(starts[look].tolist(), ends[look].tolist()):
                if shingle != keys[a]:
                    if current is not None:
                        current.close(out)
                    current, shingle = _List(percent, long_list), keys[a]
                for n, node in zip(sizes[a:b].tolist(), nodes[a:b].tolist()):
                    current.add(n, node, out)
                if len(out) > 100_000:
                    yield _edge_batch(out, names, kinds)
                    out = []
            yield _edge_batch(out, names, kinds)
        if current is not None:
            out = []
            current.close(out)
            yield _edge_batch(out, names, kinds)

    lists = postings.repartition("shingle").sortWithinPartitions("shingle", "n", "node")
    met = lists.mapInArrow(run, "a bigint, b bigint, met int, need int")
    total = met.groupBy("a", "b").agg(F.sum("met").alias("met"), F.max("need").alias("need"))
    return total.where("met >= need").select("a", "b")


def _edge_batch(rows: list, names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def divide_skip(lists: list[list[int]], threshold: int, skip: int) -> tuple[dict[int, int], list[list[int]]]:
    """Ids met at least ``threshold - skip`` times in all but the ``skip`` longest lists.

    Lists hold ascending ids. Returns the ids with their counts, and the lists left out.
    """
    lists = sorted(lists, key=len)
    cut = len(lists) - skip
    short, long = lists[:cut], lists[cut:]
    need, found = threshold - skip, {}
    last, count = None, 0
    for i in heapq.merge(*short):
        if i == last:
            count += 1
        else:
            if last is not None and count >= need:
                found[last] = count
            last, count = i, 1
    if last is not None and count >= need:
        found[last] = count
    return found, long


def _has(ids: list[int], i: int) -> bool:
    lo, hi = 0, len(ids)
    while lo < hi:
        mid = (lo + hi) // 2
        if ids[mid] < i:
            lo = mid + 1
        else:
            hi = mid
    return lo < len(ids) and ids[lo] == i


class Group:
    """Search inside one group of candidates; sets come in ascending size."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lists: dict[int, list[int]] = {}
        self.sets: list[np.ndarray] = []
        self.nodes: list[tuple[int, int]] = []  # (node, block)
        self.parent: list[int] = []
        self.parts = 0  # components so far

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[self.root(i)] = self.root(j)
        self.parts -= 1

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        return int((b[at] == a).sum()) >= overlap(len(a), len(b), self.percent)

    def add(self, node: int, block: int, shingles: np.ndarray) -> None:
        """Join a set to the components of all sets before it that it links to."""
        me, n = len(self.sets), len(shingles)
        self.parent.append(me)
        self.parts += 1
        self.sets.append(shingles)
        self.nodes.append((node, block))
        first = next((i for i in range(me) if 100 * len(self.sets[i]) >= self.percent * n), me) if me < 64 else self._first(n)
        # the newest set of fitting size is a likely partner and saves most searches
        if first < me and self.linked(shingles, self.sets[me - 1]):
            self.join(me, me - 1)
        if first < me and self.parts > 1:
            mine = self.root(me)
            strange = [i for i in range(first, me) if self.root(i) != mine]
            if strange:
                self._search(me, n, required(n, self.percent), strange)
        for s in shingles.tolist():
            self.lists.setdefault(s, []).append(me)

    def _first(self, n: int) -> int:
        lo, hi = 0, len(self.sets) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if 100 * len(self.sets[mid]) >= self.percent * n:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def _search(self, me: int, n: int, threshold: int, strange: list[int]) -> None:
        """T-occurrence search of set ``me`` among the sets that are not yet in its component."""
        wanted = set(strange)
        lists = []
        for s in self.sets[me].tolist():
            ids = self.lists.get(s)
            if ids:
                ids = ids if len(wanted) == me else [i for i in ids if i in wanted]
                if ids:
                    lists.append(ids)
        if len(lists) < threshold:
            return
        longest = max(map(len, lists))
        skip = min(threshold - 1, int(threshold / (0.01 * math.log2(longest + 1) + 1)))
        found, long = divide_skip(lists, threshold, skip)
        for i, count in found.items():
            if self.root(i) == self.root(me):
                continue
            need = overlap(n, len(self.sets[i]), self.percent)
            for k, ids in enumerate(long):
                if count >= need or count + len(long) - k < need:
                    break
                count += _has(ids, i)
            if count >= need:
                self.join(me, i)

    def links(self) -> list[tuple[int, int]]:
        """One edge for every set that is not its component's root."""
        return [(self.nodes[i][0], self.nodes[self.root(i)][0]) for i in range(len(self.nodes)) if self.root(i) != i]


def _search_groups(sets: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` of the forest of links; input ``task, node, block, n, shingles``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, group = None, None
        for batch in batches:
            out: list = []
            for key, node, block, raw in zip(*(batch.column(c).to_pylist() for c in ("task", "node", "block", "shingles"))):
                if key != task:
                    if group is not None:
                        out += group.links()
                    task, group = key, Group(percent)
                group.add(node, block, np.frombuffer(raw, np.uint64))
            yield _edge_batch(out, ["a", "b"], [pa.int64(), pa.int64()])
        if group is not None:
            yield _edge_batch(group.links(), ["a", "b"], [pa.int64(), pa.int64()])

    ordered = sets.repartition("task").sortWithinPartitions("task", "n", "node")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def _candidate_sets(docs: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """``node, shingles`` once for every node of ``groups``; ``docs`` has ``key, text``.

    A bounded Bloom filter of the keys lets most rows out before they are split into words; the
    join removes what it lets through by chance.
    """
    bits = sketch.bits_for(groups.count())
    keys = sketch.build(groups.select("key"), bits, 4)
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            picked = pa.array(np.flatnonzero(sketch.contains(shared.value, hashes, 4)))
            texts = batch.column(1).take(picked)
            nodes, sets = [], []
            for _, s in _sets(texts, k):
                nodes.append(set_id(s))
                sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])

    found = docs.mapInArrow(run, "node bigint, shingles binary")
    return found.join(groups.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _tasks(groups: DataFrame, group_nodes: int) -> DataFrame:
    """``node, task, block``: a group as one task, or every two blocks of a large one."""
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    dealt = groups.join(sizes, "root").select(
        "node", "root", F.ceil(F.col("size") / group_nodes).cast("int").alias("blocks")
    )
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return dealt.select("node", "root", block.alias("block"), other).select(
        "node",
        "block",
        F.struct("root", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).alias("task"),
    )


def linked(
    docs: DataFrame, k: int = 5, percent: int = 80, long_list: int = LONG_LIST, group_nodes: int = GROUP_NODES
) -> DataFrame:
    """``doc_id, n_shingles, component_id, row_key`` for every row of ``docs``."""
    docs = _keyed(docs)
    staging = Staging(docs.sparkSession, "jaccard")
    described = staging.put(_described(docs, k), "described")
    rows = described.where("node IS NOT NULL").select("doc_id", "key", "node", "n")
    counts = docs.sparkSession.sparkContext.broadcast(_sketch(described.where("block IS NOT NULL")))
    edges = _candidate_edges(_postings(docs, counts, k, percent), percent, long_list)
    candidates = staging.put(edges, "candidates")
    groups = components(candidates, staging)

    first = rows.groupBy("node").agg(F.min("key").alias("key"))
    groups = staging.put(groups.join(first, "node"), "groups")
    sets = _candidate_sets(docs.select("key", "text"), groups, k)
    tasks = _tasks(groups.select("node", "root"), group_nodes)
    dealt = sets.select("node", "shingles", (F.octet_length("shingles") / 8).cast("int").alias("n")).join(tasks, "node")
    links = staging.put(_search_groups(dealt, percent), "links")
    roots = staging.put(components(links, staging), "roots")

    placed = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    some = placed.where("n > 0").join(least, "root")
    alone = placed.where("n = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id", F.col("key").alias("row_key")]
    return some.select(*columns).unionByName(alone.select(*columns))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component, with their columns.

    Rows that repeat such an id in the same component stay with it; so do rows without an id where
    a component has no other. A bounded Bloom filter of the rows to drop lets all others pass
    without a shuffle.
    """
    staging = Staging(docs.sparkSession, "jaccard")
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    dropped = staging.put(linked(docs, k, percent).where(~same).select(F.col("row_key").alias("key")), "dropped")
    shared = docs.sparkSession.sparkContext.broadcast(
        sketch.build(dropped, sketch.bits_for(dropped.count()), 4)
    )

    @F.arrow_udf("boolean")
    def suspect(column: pa.Array) -> pa.Array:
        hashes = column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        return pa.array(sketch.contains(shared.value, hashes, 4))

    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    keyed = docs.select(F.xxhash64(docs["doc_id"], docs["text"]).alias("key"), row)
    passed = keyed.where(~suspect("key"))
    checked = keyed.where(suspect("key")).join(dropped, "key", "left_anti")
    return passed.select("row.*").unionByName(checked.select("row.*"))

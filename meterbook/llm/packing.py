"""Best-fit decreasing packing of tokenised documents into sequences of a fixed length.

Documents become pieces of at most ``capacity`` tokens. Best-fit decreasing takes the pieces from
the longest to the shortest and puts each into the tightest sequence that still has room for it,
found by a segment tree over the remaining capacities, or else into a new one.

What the packing does to a piece depends on its length alone, and sequences with equal room are
interchangeable. So the rule is run once, globally and exactly, over the histogram of lengths (at
most ``capacity`` rows): a leaf of the tree holds all open sequences with that much room, as
ranges of numbers, and a step places as many equal pieces as the tightest range takes. The work is
bounded by ``capacity`` and not by the number of documents. The result are runs, "pieces i to j of
length l go into sequences b, b + 1, ... , q in each, from this offset", and they are broadcast:
a length touches every range at most once, and adds at most three ranges (``best_fit``).

Every piece gets its number among those of its length without any of them meeting in a task: a
task numbers its own pieces, and the counts of the tasks before it are added. Its run, and so its
sequence and offset, follow from that number.

Encoding (``Encoder``). Long texts are encoded in slices. Pre-tokens always end before a blank that
follows a character which is no white space, and nothing before such a blank changes what follows
it, so a text is cut there. Texts with added tokens are cut at those first.

Defined cases: null and empty texts are one piece with the end token alone; rows that repeat are
packed each; a text of any length is cut whole into pieces; columns other than id and text are not
carried by ``pieces``; ``pack`` carries all columns of its input, and columns that are already
called ``sequence_id`` or ``offset`` are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator, Mapping
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from meterbook.llm.token_count import spliceable
from meterbook.session import Staging

CAPACITY = 1024
#: Bytes of ids that a task holds before it passes them on, besides those of one document.
_FLUSH = 4 << 20
_NUMBER_BITS = 43


# How byte-level files split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level files write for bytes: printable ones for themselves, the
    others, in order, from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Tokens by their bytes, if merges are made in the order of ids; else None."""
    model, letters = spec["model"], _byte_letters()
    vocab = model.get("vocab", {})
    if model.get("type") != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
        return None
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or merged != sorted(merged) or len(vocab) < 256 + len(merged):
        return None
    added = {t["content"] for t in spec.get("added_tokens", [])}
    plain = {token: k for token, k in vocab.items() if token not in added}
    if not all(set(token) <= letters.keys() for token in plain):
        return None
    return {bytes(letters[c] for c in token): k for token, k in plain.items()}


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit numbers.

    Byte-level files whose merges are in the order of their ids are run by the faster of the two
    libraries, with the ranks read from the same file; tests compare both on texts and on every
    code point. Other files are run by ``tokenizers``.
    """

    _CUT = re.compile(r"(?<!\s) ")
    SLICE = 1 << 20

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        added = spec.get("added_tokens", [])
        marks = ("single_word", "lstrip", "rstrip", "normalized")
        fits = spliceable(path) and not any(t[m] for t in added for m in marks)
        ranks = _ranks(spec) if fits else None
        self.merger = ranks and tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.at_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None

    def _section(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = self._CUT.search(text, at + self.SLICE) if len(text) - at > self.SLICE else None
            end = cut.start() if cut else len(text)
            out.append(self.merger.encode_to_numpy(text[at:end], disallowed_special=()).astype("<u4").tobytes())
            at = end
        return b"".join(out)

    def ids(self, text: str) -> bytes:
        if self.merger is None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not any(a in text for a in self.added):
            return self._section(text)
        return b"".join(self.added.get(s) or self._section(s) for s in self.at_added.split(text) if s)


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids; only the first may be shorter."""
    first = n % capacity
    head = [(0, first)] if first else []
    return head + [(a, capacity) for a in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids``: the ids as little-endian unsigned 32-bit numbers.

    ``tokenizer_file`` must be readable on every executor.
    """
    end = np.uint32(end_id).astype("<u4").tobytes()

    def rows_of(ids: pa.Array, rows: list) -> pa.RecordBatch:
        at, piece, start, length, data = zip(*rows)
        arrays = [
            ids.take(pa.array(at, pa.int64())),
            pa.array(piece, pa.int32()),
            pa.array(start, pa.int64()),
            pa.array(length, pa.int32()),
            pa.array(data, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file)
        for batch in batches:
            rows, held = [], 0
            for at, text in enumerate(batch.column(1)):
                ids = encoder.ids(text.as_py() or "") + end
                for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    rows.append((at, k, start, length, ids[4 * start : 4 * (start + length)]))
                    held += 4 * length
                    if held >= _FLUSH:
                        yield rows_of(batch.column(0), rows)
                        rows, held = [], 0
            if rows:
                yield rows_of(batch.column(0), rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length int, ids binary"
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


class Rooms:
    """Segment tree over remaining capacities: which of them have an open sequence."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)

    def mark(self, room: int, is_open: bool) -> None:
        node = self.leaves + room
        self.any[node] = is_open
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] | self.any[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """Least room of at least ``length``, in logarithmic time."""
        node = self.leaves + length
        while not self.any[node]:
            while node & 1:  # a right child: go on beside its parent
                node //= 2
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit(histogram: Mapping[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs of best-fit decreasing, and the number of sequences.

    A run is ``length, first piece, per sequence, first sequence, offset``: pieces of that length
    from the first on, in order, fill the sequences from that one on, so many in each. For a
    length, each range of sequences with enough room is taken once as a whole, or else the length
    ends in it, which leaves up to three ranges: filled, partly filled, untouched.
    """
    rooms, ranges = Rooms(capacity), defaultdict(list)
    runs, opened = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if not ranges[room]:
                rooms.mark(room, True)
            ranges[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens for sequences of {capacity}")
        done, count = 0, histogram[length]
        while done < count:
            room = rooms.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, n = opened, -(-(count - done) // each)
                opened += n
            else:
                each = room // length
                first, n = ranges[room].pop()
                if not ranges[room]:
                    rooms.mark(room, False)
            runs.append((length, done, each, first, capacity - room))
            full = min(n, (count - done) // each)
            done += full * each
            leave(room - each * length, first, full)
            if full < n:
                rest = count - done
                if rest:
                    leave(room - rest * length, first + full, 1)
                    done = count
                leave(room, first + full + (rest > 0), n - full - (rest > 0))
    return np.array(runs, np.int64).reshape(-1, 5), opened


def _numbered(rows: DataFrame, capacity: int) -> DataFrame:
    """``row, length`` with the task that wrote the row and its number there among equal lengths."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            length = batch.column(1).to_numpy(zero_copy_only=False)
            if len(length) and not (length.min() >= 1 and length.max() <= capacity):
                raise ValueError(f"pieces must have 1 to {capacity} tokens")
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            first = np.searchsorted(ordered, ordered)
            nth = np.empty(len(length), np.int64)
            nth[order] = seen[ordered] + np.arange(len(length)) - first
            np.add.at(seen, length, 1)
            arrays = [*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "length", "part", "nth"])

    more = [T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())]
    schema = T.StructType([*rows.schema.fields, *more])
    return rows.mapInArrow(number, schema)


def _placed(runs: np.ndarray):
    """Sequence and offset of a piece from its length and its number among equal lengths."""
    keys = (runs[:, 0] << _NUMBER_BITS) | runs[:, 1]
    order = np.argsort(keys)
    keys, runs = keys[order], runs[order]

    @F.arrow_udf("struct<sequence_id:bigint,offset:int>")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        length = length.to_numpy(zero_copy_only=False).astype(np.int64)
        number = number.to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, (length << _NUMBER_BITS) | number, "right") - 1
        _, first, each, sequence, offset = runs[at].T
        k = number - first
        arrays = [pa.array(sequence + k // each), pa.array((offset + k % each * length).astype(np.int32))]
        return pa.StructArray.from_arrays(arrays, ["sequence_id", "offset"])

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id, offset``; needs a column ``length`` of 1 to ``capacity``.

    Columns that are not needed should be dropped before: all of them are staged.
    """
    staging = Staging(pieces.sparkSession, "packing")
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row = F.struct(*[pieces[c] for c in kept]).alias("row")
    numbered = staging.put(_numbered(pieces.select(row, pieces["length"].cast("int")), capacity), "numbered")
    counts = staging.put(numbered.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    # one row per length
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = best_fit(histogram, capacity)

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = _placed(runs)(F.col("length"), F.col("start") + F.col("nth"))
    placed = numbered.join(starts, ["part", "length"]).withColumn("at", place)
    return placed.select("row.*", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids, members``: the packed sequences, from pieces with their ids.

    A group has ``capacity`` tokens at most.
    """
    member = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(member)).alias("m"))
    ids = F.aggregate("m", F.lit(b""), lambda whole, x: F.concat(whole, x["ids"]))
    members = F.transform(
        "m", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"))
    )
    return grouped.select(
        "sequence_id", (F.octet_length(ids) / 4).cast("int").alias("length"), ids.alias("ids"), members.alias("members")
    )

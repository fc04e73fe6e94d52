"""Substring deduplication with automata of repeated phrases.

A window is ``window`` consecutive words of one document. A word is removed if it lies in a window
whose words also start somewhere in a document with a smaller id. All windows are judged on the
input.

1. Anchors. Among the ``gram``-word grams of a window the one with the least hash is its anchor;
   equal windows have equal anchors, and about two words in ten begin one. Only anchors shuffle.
   An anchor met in two documents is live.
2. Segments. Every live anchor gives the words of the windows that chose it. Documents without a
   live anchor take no further part.
3. Automata. Segments are dealt by anchor and stream by in order of anchor and document. In a shard
   of ``SHARD_SEGMENTS`` and more, the windows whose hash recurs are the phrases; they are compiled into an
   Aho-Corasick automaton, over words as letters, and all segments of the shard run through it in
   order. The first document in which the automaton meets a phrase has it, every later occurrence
   is to be removed. Words are compared by the automaton, hashes only say what to compile.
4. The words found are removed from the documents that have any.

Hot groups are reduced before every shuffle: of anchors that several documents of a batch share,
one is dealt by anchor and the others are known to be live; of equal segments of a batch, those
of all documents but the smallest are known to recur as a whole. Known rows are dealt by document.
An anchor with more segments than ``HOT_WORDS`` words can make, as at the edge of a passage that a
third of all documents hold, is dealt window by window, by a hash of the window's words. The bound
does not grow with the table. A shard ends with an anchor; only where one window alone has more
words than ``SHARD_WORDS`` it ends before, and the next one knows its phrases. So a worker holds
one shard.

Bloom filters of at most 64 MiB keep documents that are not affected out of the two joins; when
they fill up, more texts shuffle, at most all.

Words are split on bytes: ``bytes.split`` knows exactly space and U+0009 to U+000D.

Ids must be integers. Defined cases: null, empty and shorter texts keep all their words; a null id
is after every other id; rows that repeat an id are the same document and are not repeats of
each other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.llm import sketch, words
from meterbook.session import Staging

WINDOW = 13
GRAM = 5
SHARD_SEGMENTS = 1_000
#: An anchor is hot if its segments may have more words than this.
HOT_WORDS = 500_000
#: A shard ends at the next anchor above half of this, and at once above it; there are letters for more.
SHARD_WORDS = 1_000_000
#: Letters that a worker keeps for later shards.
_KEPT_LETTERS = 50_000
_LAST = (1 << 63) - 1
_PROBES = 4


def _chosen(hashes: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """Anchors of a slice of rows: row, hash, first window and number of windows after it."""
    inside = window - gram + 1
    grams = words.grams(hashes, gram)
    if len(grams) < inside:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none
    view = np.lib.stride_tricks.sliding_window_view(grams, inside)
    at = np.arange(len(view)) + view.argmin(axis=1)
    row = np.searchsorted(bounds, np.arange(len(view)), "right") - 1
    real = np.arange(len(view)) + window <= bounds[row + 1]
    start, at, row = np.flatnonzero(real), at[real], row[real]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    more = np.diff(np.append(first, len(at))) - 1
    return row[first], grams[at[first]], start[first] - bounds[row[first]], more


def _radix(window: int, gram: int) -> int:
    """A code is ``(start * radix + more) * 2 + live``; ``more`` is at most ``window - gram``."""
    return max(window - gram + 1, 1)


def _anchors(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    """``deal, key, code``: dealt by anchor, or by row where the anchor is already known to be live."""
    radix = _radix(window, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = []
            for first, hashes, bounds in words.hashed_words(batch.column(1)):
                row, anchor, start, more = _chosen(hashes, bounds, window, gram)
                found.append((keys[row + first], anchor.view(np.int64), (start * radix + more) * 2))
            if not found:
                continue
            key, anchor, code = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((key, anchor))
            key, anchor, code = key[order], anchor[order], code[order]
            begins = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, np.int64)
            ends = np.append(begins[1:], len(anchor))
            shared = key[begins] != key[ends - 1] if len(begins) else np.zeros(0, bool)
            live = np.repeat(shared, ends - begins)
            speaker = np.zeros(len(key), bool)
            speaker[begins] = True
            known = live & ~speaker
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.where(known, key, anchor)),
                    pa.array(key),
                    pa.array(np.where(live, code + 1, code)),
                    pa.array(np.where(known, anchor, 0)),
                ],
                ["deal", "key", "code", "anchor"],
            )

    return keyed.select("key", "text").mapInArrow(run, "deal bigint, key bigint, code bigint, anchor bigint")


def _live(anchors: DataFrame, radix: int) -> DataFrame:
    """``key, anchor, start, more`` of every anchor met in two rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "anchor", "start", "more"]
        last, holder, waiting, live = None, None, [], False

        def out(key, anchor, code) -> pa.RecordBatch:
            code = np.asarray(code, np.int64)
            columns = [np.asarray(key, np.int64), np.asarray(anchor, np.int64), code // 2 // radix, code // 2 % radix]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for batch in batches:
            deal, key, code, anchor = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            known = (code % 2 == 1) & (deal == key)
            if known.any():
                yield out(key[known], anchor[known], code[known])
            keep = ~known
            deal, key, code = deal[keep], key[keep], code[keep]
            if not len(deal):
                continue
            starts = np.append(True, deal[1:] != deal[:-1])
            begins = np.flatnonzero(starts)
            ends = np.append(begins[1:], len(deal))
            look = np.flatnonzero((ends - begins > 1) | (begins == 0) | (ends == len(deal)) | (code[begins] % 2 == 1))
            rows: tuple[list, list, list] = ([], [], [])
            for a, b in zip(begins[look].tolist(), ends[look].tolist()):
                if deal[a] != last:
                    last, holder, waiting, live = deal[a], key[a], [], False
                some = key[a:b]
                if not live and ((some != holder).any() or (code[a:b] % 2 == 1).any()):
                    live = True
                if not live:
                    waiting += code[a:b].tolist()
                    continue
                for c in waiting:
                    rows[0].append(holder), rows[1].append(last), rows[2].append(c)
                waiting = []
                rows[0].extend(some.tolist()), rows[1].extend([last] * (b - a)), rows[2].extend(code[a:b].tolist())
            if rows[0]:
                yield out(*rows)

    dealt = anchors.repartition("deal").sortWithinPartitions("deal", "key")
    return dealt.mapInArrow(run, "key bigint, anchor bigint, start bigint, more bigint")


def _of_keys(keyed: DataFrame, keys: DataFrame):
    """Column test: may the row's key be among ``keys``."""
    bits = sketch.bits_for(keys.count())
    shared = keyed.sparkSession.sparkContext.broadcast(sketch.build(keys.select("key"), bits, _PROBES))

    @F.arrow_udf("boolean")
    def test(column: pa.Array) -> pa.Array:
        hashes = column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        return pa.array(sketch.contains(shared.value, hashes, _PROBES))

    return test(F.col("key"))


def _lists(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and the flattened fields of a column of lists of structs."""
    fields = column.flatten().flatten()
    offsets = np.asarray(column.offsets) - column.offsets[0].as_py()
    return offsets, [f.to_numpy(zero_copy_only=False) for f in fields]


def _with_hot(live: DataFrame, longest: int, staging: Staging) -> DataFrame:
    """``live`` with ``hot``: has the anchor more rows of ``longest`` words than one task should get?"""
    hot = live.groupBy("anchor").count().where(F.col("count") > HOT_WORDS // longest)
    hot = staging.put(hot.select("anchor", F.lit(True).alias("hot")), "hot")
    return live.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def _windows_of_hot(is_hot, offsets, anchors, starts, more):
    """Every segment of a hot anchor as its single windows."""
    times = np.where(is_hot, more + 1, 1)
    at = np.repeat(np.arange(len(anchors)), times)
    first = np.append(0, np.cumsum(times))
    inside = np.arange(len(at)) - first[at]
    hot_rows = is_hot[at]
    return first[offsets], anchors[at], starts[at] + inside, np.where(hot_rows, 0, more[at]), hot_rows


def _segments(affected: DataFrame, window: int) -> DataFrame:
    """``deal, doc, key, starts, words, segment``: where a document has a segment of so many words.

    Without a segment the spans are known to recur. A document that repeats a segment gives one
    row with all its places.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary()]
    names = ["deal", "doc", "key", "starts", "words", "segment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, (anchors, starts, more, hot) = _lists(batch.column(3))
            offsets, anchors, starts, more, by_window = _windows_of_hot(hot, offsets, anchors, starts, more)
            each = np.diff(offsets)
            docs = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), each)
            keys = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), each)
            sizes = (more + window).tolist()
            spans = list(zip(starts.tolist(), (starts + more + window).tolist()))
            segments = []
            for text, a, b in zip(batch.column(2).cast(pa.binary()), offsets.tolist(), offsets[1:].tolist()):
                found = text.as_py().split()
                segments += [b" ".join(found[i:j]) for i, j in spans[a:b]]
            least: dict = {}
            same = list(zip(anchors.tolist(), segments))
            for place, doc in zip(same, docs.tolist()):
                if least.setdefault(place, doc) > doc:
                    least[place] = doc
            deal = anchors.tolist()
            for i in np.flatnonzero(by_window).tolist():
                deal[i] = int.from_bytes(hashlib.blake2b(segments[i], digest_size=8).digest(), "little", signed=True)
            rows: dict = {}
            for place, doc, key, to, (start, _), size in zip(same, docs.tolist(), keys.tolist(), deal, spans, sizes):
                row = (to, doc, key, size, place[1]) if least[place] == doc else (key, doc, key, size, None)
                rows.setdefault(row, []).append(start)
            to, doc, key, size, text = list(zip(*rows)) or [()] * 5
            columns = [to, doc, key, list(rows.values()), size, text]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    schema = "deal bigint, doc bigint, key bigint, starts array<int>, words int, segment binary"
    return affected.select("doc", "key", "text", "anchors").mapInArrow(run, schema)


class _Letters(dict):
    """A letter for every word, given out in order."""

    def __missing__(self, word: bytes) -> str:
        n = len(self) + 1
        letter = self[word] = chr(n if n < 0xD800 else n + 0x800)
        return letter


class Shard:
    """Segments in order of anchor and document, the automaton of their phrases, and its hits."""

    def __init__(self, window: int):
        self.window = window
        self.letters = _Letters()
        self.segments: list[tuple[int, int, int, list[int], str]] = []
        self.words = 0
        #: phrases of the open deal with the document that has them, if the deal goes on
        self.open: dict[str, int] = {}

    def add(self, deal: int, doc: int, key: int, starts: list[int], segment: bytes) -> None:
        text = "".join(map(self.letters.__getitem__, segment.split(b" ")))
        self.segments.append((deal, doc, key, starts, text))
        self.words += len(text)

    def _phrases(self) -> set[str]:
        """Windows whose hash recurs in the shard."""
        w = self.window
        text = "".join(s[-1] for s in self.segments)
        sizes = np.array([len(s[-1]) for s in self.segments])
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        hashes = words.grams(codes * np.uint64(0x9E3779B97F4A7C15), w)
        ends = np.repeat(np.cumsum(sizes), sizes)[: len(hashes)]
        at = np.flatnonzero(np.arange(len(hashes)) + w <= ends)
        _, which, n = np.unique(hashes[at], return_inverse=True, return_counts=True)
        return {text[i : i + w] for i in at[n[which] > 1].tolist()}

    def spans(self, goes_on: bool = False) -> Iterator[tuple[int, int, int]]:
        """``key, start, stop`` of all words to remove; the segments are done.

        With ``goes_on`` the last deal has more segments, else the shard forgets its phrases.
        """
        w, phrases = self.window, self._phrases().union(self.open)
        if phrases:
            automaton, owners = ahocorasick.Automaton(), []
            for phrase in phrases:
                automaton.add_word(phrase, len(owners))
                owners.append(self.open.get(phrase))
            automaton.make_automaton()
            for _, doc, key, starts, text in self.segments:
                found: list[list[int]] = []
                for at, phrase in automaton.iter(text):
                    if owners[phrase] is None:
                        owners[phrase] = doc
                    if owners[phrase] >= doc:
                        continue
                    if found and at - w + 1 <= found[-1][1]:
                        found[-1][1] = at + 1
                    else:
                        found.append([at - w + 1, at + 1])
                for start in starts if found else ():
                    for begin, end in found:
                        yield key, start + begin, start + end
        if goes_on:
            last = self.segments[-1][0]
            for deal, doc, _, _, text in self.segments:
                for i in range(len(text) - w + 1) if deal == last else ():
                    self.open.setdefault(text[i : i + w], doc)
        else:
            self.open.clear()
            if len(self.letters) > _KEPT_LETTERS:
                self.letters.clear()
        self.segments, self.words = [], 0


def _located(segments: DataFrame, window: int, shard_segments: int) -> DataFrame:
    """``key, start, stop``: spans of words to remove."""
    names, kinds = ["key", "start", "stop"], [pa.int64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = Shard(window), None

        def batch_of(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        for batch in batches:
            out: list = []
            places = batch.column(3)
            ends, flat = places.offsets.to_pylist(), places.values.to_pylist()
            deals, docs, keys, sizes, segments = (batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5))
            for deal, doc, key, a, b, size, segment in zip(deals, docs, keys, ends, ends[1:], sizes, segments):
                starts = flat[a:b]
                if segment is None:
                    out += [(key, start, start + size) for start in starts]
                    continue
                if deal != last:
                    if shard.open or len(shard.segments) >= shard_segments or shard.words > SHARD_WORDS // 2:
                        out += shard.spans()
                elif shard.words > SHARD_WORDS:
                    out += shard.spans(goes_on=True)
                last = deal
                shard.add(deal, doc, key, starts, segment)
            yield batch_of(out)
        yield batch_of(list(shard.spans()))

    dealt = segments.repartition("deal").sortWithinPartitions("deal", "doc")
    return dealt.mapInArrow(run, "key bigint, start int, stop int")


def _whole(rows: DataFrame) -> DataFrame:
    """Texts that keep all their words: white space becomes single blanks."""
    kept = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    blanks = F.length(kept) - F.length(F.replace(kept, F.lit(" "), F.lit("")))
    n_words = F.when(kept == "", 0).otherwise(blanks + 1).cast("bigint")
    return rows.select(
        "doc_id", n_words.alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"), kept.alias("kept_text")
    )


def _cut(rows: DataFrame, kind: str) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` from ``doc_id, text, spans``."""
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, texts = [], [], []
            for text, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                found = text.as_py().split()
                keep = np.ones(len(found), bool)
                for s in spans.as_py() or ():
                    keep[s["start"] : s["stop"]] = False
                kept = [found[i] for i in np.flatnonzero(keep).tolist()]
                totals.append(len(found))
                removed.append(len(found) - len(kept))
                texts.append(b" ".join(kept))
            columns = [pa.array(totals, pa.int64()), pa.array(removed, pa.int64())]
            columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
            names = ["doc_id", "n_words", "n_removed", "kept_text"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return rows.select("doc_id", "text", "spans").mapInArrow(run, schema)


def without_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_segments: int = SHARD_SEGMENTS
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for every row of ``docs``."""
    staging = Staging(docs.sparkSession, "repeats")
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("doc"),
        F.xxhash64("doc_id", "text").alias("key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    live = staging.put(_live(_anchors(keyed, window, gram), _radix(window, gram)), "live")
    marked = _with_hot(live, 2 * window - gram, staging)
    anchors = marked.groupBy("key").agg(F.collect_set(F.struct("anchor", "start", "more", "hot")).alias("anchors"))
    affected = keyed.where(_of_keys(keyed, live.select("key").distinct())).join(anchors, "key")
    spans = staging.put(_located(_segments(affected, window), window, shard_segments), "spans")

    by_row = spans.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    hit = _of_keys(keyed, spans.select("key").distinct())
    whole = _whole(keyed.where(~hit))
    return whole.unionByName(_cut(keyed.where(hit).join(by_row, "key", "left"), kind))

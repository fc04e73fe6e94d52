import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer


from meterbook.llm.packing import Encoder, Rooms, best_fit, cuts, pack, pieces, sequences

FILE = public_tokenizers.path("byte_bpe_50k.json")
END = 2


def one_by_one(lengths, capacity):
    """Best-fit decreasing, one piece after the other: the room left in every sequence."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        k = bisect_left(rooms, n)
        insort(rooms, (rooms.pop(k) if k < len(rooms) else capacity) - n)
    return sorted(rooms)


def test_tightest_room():
    rooms, is_open = Rooms(100), [False] * 101
    rng = random.Random(2)
    for _ in range(2000):
        r = rng.randint(0, 100)
        is_open[r] = not is_open[r]
        rooms.mark(r, is_open[r])
        n = rng.randint(0, 100)
        assert rooms.tightest(n) == next((x for x in range(n, 101) if is_open[x]), None)


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 5, 10, 64, 100])
    mean = capacity * rng.choice([0.1, 0.3, 0.6])
    lengths = Counter(min(capacity, 1 + int(rng.expovariate(1 / mean))) for _ in range(rng.randint(0, 600)))
    runs, n = best_fit(lengths, capacity)
    inside = defaultdict(list)
    for length, count in lengths.items():
        own = sorted(r for r in runs.tolist() if r[0] == length)
        for i in range(count):
            _, first, each, sequence, offset = [r for r in own if r[1] <= i][-1]
            k = i - first
            inside[sequence + k // each].append((offset + k % each * length, length))
    assert sorted(inside) == list(range(n))
    for members in inside.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(x for _, x in m) for m in inside.values()) == one_by_one(lengths.elements(), capacity)


def test_runs_do_not_grow_with_the_number_of_pieces():
    rng = random.Random(1)
    few = {n: rng.randint(1, 9) for n in range(1, 1025)}
    many = {n: k * 10**9 + 7 for n, k in few.items()}
    runs, sequences_used = best_fit(many, 1024)
    assert len(runs) < 20_000
    assert sequences_used <= sum(n * k for n, k in many.items()) / 1024 * 1.01  # of the least that could hold them


def texts():
    rng = random.Random(3)
    bits = [" ", "  ", "\n", " \n", "word", "it's", "12", "é", "日本", "😀", "<|endoftext|>", "<|endof", "!!", "\t", "\x1c", "\x85", "\xa0", "　", " x", " 's"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 15))) for _ in range(4000)]


def test_encoder_equals_the_library(monkeypatch):
    library, encoder = Tokenizer.from_file(FILE), Encoder(FILE)
    assert encoder.merger is not None
    some = [f"a{chr(c)}b {chr(c)}{chr(c)}1 !{chr(c)} {chr(c)} x" for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    for part in (texts(), some):
        for text, e in zip(part, library.encode_batch_fast(part, add_special_tokens=False)):
            assert encoder.ids(text) == np.array(e.ids, "<u4").tobytes(), text
    monkeypatch.setattr(Encoder, "SLICE", 20)  # many slices
    for text in [" ".join(texts()[:300]), "a " * 500 + "  b" * 100, "no_blank" * 50]:
        assert encoder.ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    other = public_tokenizers.path("word_bpe_49k.json")
    want = Tokenizer.from_file(other).encode("Some words, here", add_special_tokens=False).ids
    assert Encoder(other).ids("Some words, here") == np.array(want, "<u4").tobytes()


def test_only_the_first_piece_is_shorter():
    assert cuts(5, 10) == [(0, 5)] and cuts(10, 10) == [(0, 10)] and cuts(20, 10) == [(0, 10), (10, 10)]
    assert cuts(23, 10) == [(0, 3), (3, 10), (13, 10)]


def test_documents_come_back_from_their_sequences(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "word", "né", "日本"]) for _ in range(rng.choice([0, 3, 30, 400])))) for i in range(120)]
    rows += [(7, None), (7, None), (None, ""), (500, "long text " * 3000)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id bigint, text string, offset int, row string")
    docs = docs.repartition(5)
    cut = pieces(docs, FILE, END, capacity=64)
    packed = pack(cut, 64)
    library = Tokenizer.from_file(FILE)
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [END]
        data = np.array(ids, "<u4").tobytes()
        want.update((i, k, a, n, data[4 * a : 4 * (a + n)]) for k, (a, n) in enumerate(cuts(len(ids), 64)))
    out = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in out) == want
    used = defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    lengths = [n for _, _, _, n, _ in want.elements()]
    assert sorted(64 - sum(x[1] for x in m) for m in used.values()) == one_by_one(lengths, 64)
    whole = {r.sequence_id: r for r in sequences(packed).collect()}
    for sequence, members in used.items():
        assert bytes(whole[sequence].ids) == b"".join(ids for _, _, ids in sorted(members))
        assert whole[sequence].length == sum(n for _, n, _ in members) <= 64
        assert [m.offset for m in whole[sequence].members] == sorted(o for o, _, _ in members)


def test_pack_replaces_its_own_columns_and_takes_empty_tables(spark):
    rows = spark.createDataFrame([(3, "a", 9, 9), (3, "b", 9, 9), (7, "c", 9, 9)], "length int, part string, offset int, sequence_id int")
    got = pack(rows, 10).orderBy("part").collect()
    assert [r.part for r in got] == ["a", "b", "c"] and set(got[0].asDict()) == {"length", "part", "offset", "sequence_id"}
    assert len({r.sequence_id for r in got}) == 2
    assert pack(rows.where("length > 9"), 10).collect() == []
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert pack(pieces(docs, FILE, END)).collect() == []
    with pytest.raises(Exception, match="1 to 5 tokens"):
        pack(rows, 5).collect()


def test_query_digests(spark, tmp_path):
    from meterbook.llm.queries import QUERIES

    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op13_best_fit_packing"](spark, str(tmp_path)).collect()}
    ids = Tokenizer.from_file(FILE).encode("one two", add_special_tokens=False).ids + [END]
    assert got[1].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and got[1].length == len(ids)
    assert got[2].ids_crc32 == zlib.crc32(np.array([END], "<u4").tobytes()) and got[1].sequence_id == got[2].sequence_id

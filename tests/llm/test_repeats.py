import random
import re

import pytest

from meterbook.llm import repeats as R


def brute(rows, w):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    order = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, found in docs:
        for a in range(len(found) - w + 1):
            key = tuple(found[a : a + w])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, found in docs:
        gone = set()
        for a in range(len(found) - w + 1):
            if first[tuple(found[a : a + w])] < order(i):
                gone.update(range(a, a + w))
        out.append((i, len(found), len(gone), " ".join(x for n, x in enumerate(found) if n not in gone)))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["é", "日本", "a b", "x y"]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [prose(rng.choice([5, 12, 13, 14, 20, 50])) for _ in range(30)]
    common = prose(16)
    rows = []
    for i in range(300):
        parts = [prose(rng.choice([0, 1, 6, 30]))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), prose(rng.randrange(4))]
        if i % 3 == 0:
            parts.insert(0, common)
        if i % 50 == 0:
            parts += [["same"] * 40, prose(3) * 20]
        found = [x for p in parts for x in p]
        rows.append((rng.randrange(-5, 400), "".join(x + rng.choice([" ", "\n", " \t"]) for x in found)))
    copy = " ".join(prose(60))
    rows += [(1000 + i, copy) for i in range(80)] + [(2, copy)]
    rows += [(None, copy), (None, rows[0][1]), (5000, None), (5001, ""), (5002, " \n"), (5003, "long text " * 20_000)]
    return rows + rows[:4]


@pytest.mark.parametrize(
    "seed, window, gram, shard, hot, shard_words",
    [
        (1, 13, 5, 4000, 500_000, 1_000_000),
        (2, 13, 5, 7, 20 * 21, 1_000_000),
        (3, 6, 2, 1, 0, 20),
        (4, 13, 13, 50, 40_000, 300),
    ],
)
def test_every_row_against_all_windows(spark, monkeypatch, seed, window, gram, shard, hot, shard_words):
    monkeypatch.setattr(R, "HOT_WORDS", hot)
    monkeypatch.setattr(R, "SHARD_WORDS", shard_words)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, key string, doc int")
    got = R.without_repeats(df.repartition(6), window, gram, shard).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, window)


def test_empty_table(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    assert R.without_repeats(df.limit(0)).collect() == []
    assert tuple(R.without_repeats(df).first()) == (1, 1, 0, "a")


@pytest.mark.parametrize("window, gram", [(50, 5), (22, 6)])
def test_windows_much_longer_than_their_grams(spark, window, gram):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = R.without_repeats(df.repartition(6), window, gram).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, window)


def test_a_phrase_of_many_shards_has_one_owner(monkeypatch):
    monkeypatch.setattr(R, "SHARD_WORDS", 8)
    shard, out = R.Shard(3), []
    for doc in range(10):
        if shard.words > R.SHARD_WORDS:
            out += shard.spans(goes_on=True)
        shard.add(7, doc, doc + 100, [doc], b"a b c")
    out += shard.spans()
    assert out == [(doc + 100, doc, doc + 3) for doc in range(1, 10)]
    assert not shard.open and not shard.segments


def test_phrases_do_not_cross_segments():
    shard = R.Shard(2)
    for doc, segment in enumerate((b"a b", b"c d", b"b c", b"a b", b"b c")):
        shard.add(0, doc, doc, [0], segment)
    assert sorted(shard.spans()) == [(3, 0, 2), (4, 0, 2)]

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from meterbook.llm import ranked
from meterbook.llm.ranked import Shard, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_definition(docs, items, k):
    """Every document scored for every query."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n, total = len(bags), sum(size for *_, size in bags)
    containing = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for doc, bag, size in bags:
            m, score = 100 - 90 + (90 * size * n) // total, 0
            for t in set(terms(text)) & bag.keys():
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * containing[t] + 1)))
                score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc if doc is not None else 0, doc))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Éa", "日本", "The", "THE", "x-y", "a_b", "don't", "12"]
    text = lambda size: rng.choice([" ", ", ", "\n"]).join(rng.choices(words, [1 / (1 + i) for i in range(len(words))], k=size))
    docs = [(i, text(rng.choice([0, 1, 2, 5, 20, 200]))) for i in range(n)]
    docs += [(n + i, docs[3 * i][1]) for i in range(20)]  # copies, so scores tie
    items = [(i, text(rng.choice([1, 3, 8, 40]))) for i in range(15)]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id bigint, text string"),
    )


def results(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_terms():
    text = "Ab c_d É日本 x\x00y 3.5~"
    assert [t.decode() for part in terms_of(text.encode()) for t in part] == terms(text)


def test_long_texts_are_read_in_slices(monkeypatch):
    monkeypatch.setattr(ranked, "_SLICE_BYTES", 7)
    text = "some longer words, ÄÖ and 日本日本日本日本日本 x " * 9
    parts = list(terms_of(text.encode()))
    assert len(parts) > 5 and [t.decode() for part in parts for t in part] == terms(text)


@pytest.mark.parametrize("seed", range(30))
def test_intervals_close_on_the_best(seed, monkeypatch):
    monkeypatch.setattr(ranked, "FIRST_DEPTH", 2)
    monkeypatch.setattr(ranked, "GROWTH", 2)
    rng = np.random.default_rng(seed)
    n_docs, n_terms, k = 200, 12, int(rng.integers(1, 12))
    rows = [np.flatnonzero(rng.random(n_terms) < rng.choice([0.05, 0.4])) for _ in range(n_docs)]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    terms_, counts = np.concatenate(rows).astype(np.int32), rng.integers(1, 4, bounds[-1])
    lengths = rng.integers(5, 9, n_docs)
    ids = rng.permutation(n_docs).tolist()
    shard = Shard(ids, lengths, bounds, terms_, counts, n_docs, int(lengths.sum()))
    weights = rng.integers(0, 4, n_terms) * 100
    query = [(t, int(weights[t])) for t in range(n_terms)] + [(99, 5)]
    scores = Counter()
    for d in range(n_docs):
        a, b = bounds[d], bounds[d + 1]
        impact = ranked.impacts(counts[a:b], lengths[d : d + 1].repeat(b - a), n_docs, int(lengths.sum()))
        scores[ids[d]] = int((weights[terms_[a:b]] * impact).sum())
    want = sorted((-s, i) for i, s in scores.items() if s > 0)
    for least in (0, -want[k][0], -want[0][0] + 1):
        docs, found = shard.best(query, k, least)
        assert [(-s, shard.ids[d]) for d, s in zip(docs, found)] == [w for w in want[:k] if -w[0] >= least]


@pytest.mark.parametrize("postings, terms_a_block", [(1 << 20, 1 << 20), (300, 5)])
def test_equals_scoring_everything(spark, monkeypatch, postings, terms_a_block):
    monkeypatch.setattr(ranked, "BLOCK_TERMS", terms_a_block)
    docs, items = corpus(7, 300)
    docs += [(None, "w1 w2"), (None, "w1 w2"), (5, "w1 w2"), (5, "w1 w2"), (900, None), (901, "…!"), (902, "w1 " * 5000)]
    items += [(50, None), (51, ""), (52, "unknownterm"), (53, "w1 W1 w1"), (53, "w1")]
    d, i = frames(spark, docs, items)
    d = d.repartition(3).withColumnsRenamed({}).selectExpr("doc_id", "text", "1 AS score", "2 AS terms")
    assert results(search(d, i, 10)) == by_definition(docs, items, 10)


def test_empty_tables(spark):
    d, i = frames(spark, [(1, "a")], [(1, "a")])
    assert search(d.limit(0), i).collect() == search(d, i.limit(0)).collect() == []
    assert results(search(d, i)) == by_definition([(1, "a")], [(1, "a")], 10)

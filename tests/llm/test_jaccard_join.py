import random
import re

import pytest

from meterbook.llm import jaccard_join as J


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < k:
        return {tuple(words)}
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent):
    """All pairs of distinct sets."""
    sets = [frozenset(shingles(t, k)) for _, t in rows]
    kinds = list(set(sets) - {frozenset()})
    parent = {s: s for s in kinds}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if 100 * len(a & b) >= percent * len(a | b):
                parent[root(a)] = root(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[root(s)] = min(least.get(root(s), i), i)
    return [(i, len(s), least.get(root(s)) if s else i) for (i, _), s in zip(rows, sets)]


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    common = " ".join(rng.choice(vocabulary) for _ in range(25))
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = []
    for _ in range(60):
        texts.append(" ".join(prose(rng.choice([0, 1, 2, 3, 4, 5, 8, 30, 200]))))
    for _ in range(40):  # families with growing edits
        base = prose(rng.choice([9, 12, 20, 40, 120]))
        for _ in range(rng.randrange(1, 6)):
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(" ".join(base))
    for _ in range(150):  # one passage that many share, alone or nearly so
        texts.append(common + " " + " ".join(prose(rng.choice([0, 1, 2, 3, 4, 60]))))
    base = prose(80)
    for _ in range(160):  # a large group of near copies
        copy = list(base)
        copy[rng.randrange(80)] = rng.choice(vocabulary)
        texts.append("  ".join(copy).upper())
    texts += ["same text here for copies of it " * 3] * 90 + [None, "", " \t\n", "É é x", "x " * 30_000]
    rows = list(enumerate(texts)) + [(None, texts[-20]), (None, "only this null id has such words in it ok")]
    rng.shuffle(rows)
    return rows + rows[:5]


@pytest.mark.parametrize("k, percent, long_list, group", [(4, 85, 48, 20_000), (5, 80, 6, 40), (2, 60, 20, 100)])
def test_components_against_all_pairs(spark, k, percent, long_list, group):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, node string, root int")
    got = J.linked(df.repartition(5), k, percent, long_list, group).collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == sorted(brute(rows, k, percent), key=repr)


def test_divide_skip_against_counting():
    rng = random.Random(9)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randrange(1, 25))) for _ in range(rng.randrange(1, 15))]
        t = rng.randrange(1, len(lists) + 1)
        skip = rng.randrange(0, t)
        found, long = J.divide_skip(lists, t, skip)
        total = {i: c + sum(J._has(x, i) for x in long) for i, c in found.items()}
        want = {i for i in range(30) if sum(i in x for x in lists) >= t}
        assert {i for i, c in total.items() if c >= t} == want


def test_string_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("b", "one two three"), ("a", "One  two three")], "doc_id string, text string")
    assert {tuple(r)[:3] for r in J.linked(df).collect()} == {("a", 1, "a"), ("b", 1, "a")}
    assert J.linked(df.limit(0)).collect() == []


def test_one_document_of_each_group_stays(spark):
    rows = corpus(8)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, key string, row int")
    kept = J.representatives(df)
    assert kept.columns == df.columns
    placed = brute(rows, 5, 80)
    want = [(i, t, "x", 1) for (i, t), (_, _, c) in zip(rows, placed) if i == c]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr)
    assert J.representatives(df.limit(0)).collect() == []

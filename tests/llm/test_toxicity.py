import random
from itertools import product

import pytest

from meterbook.llm import toxicity as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    terms = ["abcde", "abxde", "aaaa", "bcdea", "abcdeabcde", "edcba"]
    automaton = T.Automaton([(t, False) for t in terms])
    rng = random.Random(1)
    words = ["".join(p) for n in range(6) for p in product("abx", repeat=n)]
    words += ["".join(rng.choice("abcdex") for _ in range(rng.randrange(3, 13))) for _ in range(4000)]
    for t in terms:
        words += [t, t[1:], t + "a", t[:3] + "x" + t[4:], t[2:], t[:-1] + "xx"]
    for w in words:
        fits = [(d, t) for t in terms if (d := distance(w, t)) <= T.errors_allowed(len(t))]
        got = automaton.match(w)
        assert (got is None) == (not fits), w
        if got:
            assert got[1] == min(fits)[0] == distance(w, terms[got[0]])


def test_stems_and_forms():
    automaton = T.Automaton([("lowei", True), ("idiot", False)])
    assert automaton.match("loweiabc") == (0, 0) and automaton.match("lowi") is None
    assert automaton.match("idiott") == (1, 1)
    hits = T._Hits(automaton)
    for word in ["1d10t", '"idiot!"', "i.d.i.o.t", "***idiot", "id1ot$"]:
        assert hits[word] and hits[word][0] == 1, word
    assert hits[""] is None and hits["--"] is None


def test_stems_with_errors_against_edit_distance():
    terms = [("abcde", True), ("idiot", True), ("idio", True), ("idiot", False), ("bcdeabcd", True)]
    automaton = T.Automaton(terms)
    rng = random.Random(3)
    words = ["ldiots", "iidiots", "idiiotic", "ldiot", "idot", "idio", "idit", "ldio", "abxdex", "abcd", "abcdx"]
    words += ["".join(rng.choice("abcdeiot") for _ in range(rng.randrange(3, 12))) for _ in range(3000)]
    words += [t[:i] + "x" + t[i + 1 :] + e for t, _ in terms for i in range(len(t)) for e in ("", "s", "abx")]
    for w in words:
        fits = []
        for t, is_stem in terms:
            if not is_stem:
                fits += [d for d in [distance(w, t)] if d <= T.errors_allowed(len(t))]
                continue
            ends = range(len(w) + 1)
            fits += [d for i in ends if (d := distance(w[:i], t)) <= T.errors_allowed(len(t)) and (not d or i < len(w))]
        got = automaton.match(w)
        assert (got and got[1]) == min(fits, default=None), w


def test_misspellings_inside_a_chosen_stem(spark):
    rng = random.Random(5)
    prose = ["".join(rng.choice("bcdfghklmn") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    docs, labels = [], []
    for i in range(1200):
        words = [rng.choice(prose) for _ in range(rng.randrange(20, 60))]
        if i % 6 == 0:
            words[3] = words[9] = rng.choice(["idiot", "idiot", "idiots", "idiocy", "idioot"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0), 1))
    docs += [(2000 + n, " ".join([*prose[:10], w, *prose[10:20]])) for n, w in enumerate(["ldiot", "iidiot", "idio", "idiocy"])]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = T.learn(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int"))
    assert ("idio", True) in model.terms
    automaton = T.Automaton(model.terms)
    assert all(automaton.match(w) for w in ("ldiot", "iidiot", "idxot", "idiocy"))
    score = {r.doc_id: r.toxicity for r in T.scored(docs, model).where("doc_id >= 2000").collect()}
    assert min(score[2000], score[2001], score[2003]) >= 0.5


def test_context():
    quoted = 'he said “what an idiot you are” to them'.split()
    assert T.context_score(quoted, quoted.index("idiot")) < 0
    abuse = "oh you idiot go away".split()
    assert T.context_score(abuse, 2) > 0
    plain = "some idiot here".split()
    assert T.context_score(plain, 1) == 0


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    prose = ["".join(rng.choice("abcdefghi") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    marks = ["zzarno", "quilvex", "brontoph"]
    docs, labels = [], []
    for i in range(1200):
        words = [rng.choice(prose) for _ in range(rng.randrange(1, 120))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words) + 1), rng.choice(marks))
        docs.append((i, " ".join(words), "en", "x", 0.5))
        if i % 3:
            labels.append((i, int(toxic), 1))
    copied = "only " + " ".join(rng.choice(prose) for _ in range(60)) + " zzarno quilvex"
    docs += [(2000 + i, copied, "en", None, None) for i in range(60)]
    labels += [(2000 + i, 1, 1) for i in range(60)]
    docs += [
        (3001, None, None, None, None),
        (3002, "", None, None, None),
        (3003, "you qu1lvexx!", None, None, None),
        (3004, "filler " * 200_000 + "brontoph zzarno", None, None, None),
        (3005, "plain words", None, None, None),
        (3005, "plain words", None, None, None),
        (None, "zzarno quilvex", None, None, None),
    ]
    labels += [(3005, None, 0), (None, 1, 0), (1, 1, 0), (1, 0, 0)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, toxic string, toxicity double")
    return docs, spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int"), marks


def test_held_out_rows_and_whole_texts(corpus):
    docs, labels, marks = corpus
    model = T.learn(docs.drop("toxicity"), labels.where(~T.held_out(labels.doc_id)))
    words = {t for t, _ in model.terms}
    assert len(words) < 20 and all(any(m.startswith(w) for w in words) for m in marks)
    rows = T.scored(docs.drop("toxicity"), model).collect()
    assert len(rows) == docs.count() and all(0 <= r.toxicity <= 1 for r in rows)
    wrong = [r.doc_id for r in rows if r.doc_id is not None and 1 < r.doc_id < 1200 and (r.toxicity >= 0.5) != (r.doc_id % 8 == 0)]
    assert len(wrong) <= 6
    score = {r.doc_id: r.toxicity for r in rows}
    assert score[3001] == score[3002] < 0.5 and score[3005] < 0.5
    assert min(score[3003], score[3004], score[None], score[2001]) >= 0.5


def test_rejected_rows_go_and_columns_stay(corpus):
    docs, labels, _ = corpus
    kept = T.clean(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 3001 in ids and ids.count(3005) == 2 and 3004 not in ids and 2001 not in ids


def test_without_labels_or_rows(corpus):
    docs, labels, _ = corpus
    none = T.learn(docs, labels.limit(0))
    assert T.scored(docs.limit(3).drop("toxicity"), none).where("toxicity >= 0.5").isEmpty()
    assert T.clean(docs.limit(0), labels).collect() == []
    assert T.clean(docs.limit(0), labels).columns == docs.columns


def test_only_near_copies_of_one_label_leave_the_sample(spark):
    rng = random.Random(9)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, copied = prose(40), prose(100)
    shared = [(i, " ".join(passage + prose(40)), i % 2) for i in range(60)]
    copies = [(100 + i, " ".join([*copied[:-1], f"end{i}"]), i % 2) for i in range(20)]
    odd = [(200, None, 0), (201, "", 1), (202, " ", 1), (203, "two words", 0)]
    rows = shared + copies + odd
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, t, 1) for i, _, t in rows], "doc_id bigint, toxic int, quality int")
    with T.Staging(spark, "test") as staging:
        got = T._sampled(docs, labels, 10_000, staging).collect()
    want = [(t, y) for _, t, y in shared + copies[:2] + odd]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)

import random

import numpy as np
import pytest

from meterbook.llm import decontaminate as D


def prose(rng, n):
    parts = ["the", "tion", "ing", "er", "an", "re", "ción", "que", "st", "ble"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("xyz")
        elif kind == 1:
            del chars[at]
        else:
            chars.insert(at, rng.choice("xyz"))
    return "".join(chars)


def least_edits(item, text):
    """Whole item against any stretch of the text."""
    row = np.zeros(len(text) + 1, np.int64)
    ramp = np.arange(len(text) + 1)
    points = np.array(list(map(ord, text)))
    for i, ch in enumerate(item, 1):
        new = np.concatenate([[i], np.minimum(row[:-1] + (points != ord(ch)), row[1:] + 1)])
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


def plain(text):
    points, _ = D.normalised(text or "")
    return "".join(map(chr, points))


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    items = [(i, prose(rng, n)) for i, n in enumerate([5, 6, 8, 12, 30, 30, 45, 60])]
    items += [(90, None), (91, ""), (92, "short"), (93, items[4][1]), (94, "x" * 24), (95, "ab " * 30)]
    docs = []
    for i in range(160):
        text = prose(rng, rng.randrange(0, 300))
        if i % 2:
            _, item = items[i % 8]
            k = int(D.BUDGET * len(item))
            item = edited(rng, item, rng.choice([0, 1, k // 2, k, k + 1, 2 * k]))
            at = rng.randrange(len(text) + 1)
            text = text[:at] + (item.upper() if i % 3 == 0 else item.replace(" ", " \n\t")) + text[at:]
        docs.append((i, text, "x", 1))
    docs += [(500, None, "x", 1), (501, "", "x", 1), (502, items[5][1], "x", 1), (502, items[5][1], "x", 1)]
    docs += [(503, items[6][1][3:], "x", 1), (504, "x" * 30, "x", 1), (None, items[7][1], "x", 1), (505, "\x00 ퟿ é", "x", 1)]
    return docs, items


def test_every_pair_against_full_alignment(spark, case, monkeypatch):
    docs, items = case
    monkeypatch.setattr(D, "BLOCK_CHARS", 400)  # several blocks of items
    got = D.matches(
        spark.createDataFrame(docs, "doc_id bigint, text string, item_id string, edits int"),
        spark.createDataFrame(items, "item_id bigint, text string"),
    ).collect()
    want = []
    for i, text, *_ in docs:
        for n, item in items:
            item = plain((item or "").strip())
            if len(item) >= D.MIN_ITEM_CHARS:
                edits = least_edits(item, plain(text))
                if edits <= int(D.BUDGET * len(item)):
                    want.append((i, n, edits))
    assert sorted(((r.doc_id, r.item_id, r.edits) for r in got), key=repr) == sorted(want, key=repr)
    assert len(want) > 60
    text = {i: t for i, t, *_ in docs}
    for r in got:
        if r.edits == 0:
            assert plain(text[r.doc_id][r.first_char : r.end_char]).strip() in plain(text[r.doc_id])


def test_long_texts_in_slices(monkeypatch, case):
    docs, items = case
    index = [D.Index(8, [(5, D.normalised(items[5][1])[0])], D.BUDGET)]
    filler = prose(random.Random(2), 4000)
    monkeypatch.setattr(D, "SLICE_CHARS", 1000)
    for at in range(0, 2400, 150):
        text = filler[:at] + items[5][1] + filler[at:]
        (found,) = D.matches_of(text, index)
        assert found[:2] == (5, 0) and text[found[2] : found[3]] in items[5][1]


def test_rows_without_a_match_stay(spark, case):
    docs, items = case
    table = spark.createDataFrame(docs, "doc_id bigint, text string, row string, item_id int")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    hit = {r.doc_id for r in D.matches(table, benchmark).collect()}
    kept = D.decontaminated(table, benchmark)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *_ in docs if i not in hit)
    assert D.decontaminated(table, benchmark.limit(0)).count() == len(docs)
    assert D.matches(table.limit(0), benchmark).collect() == []


def test_short_items_are_found_unchanged_and_as_whole_words(spark):
    items = [(1, "Short benchmark\n item!"), (2, "he walked"), (3, "x"), (4, " "), (5, None), (6, "he walked"), (7, "日本")]
    texts = {
        1: "before, short  benchmark item! after", 2: "short benchmark items", 3: "then HE walked.", 4: "she walked, he walkedx",
        5: "(x)", 6: "xx x1", 7: "", 8: None, 9: "short benchmark itam!", 10: "he walked", 11: "日本", 12: "日本人 (日本)",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(map(tuple, D.matches(docs, benchmark).collect()))
    assert got == [
        (1, 1, 0, 8, 30), (3, 2, 0, 5, 14), (3, 6, 0, 5, 14), (5, 3, 0, 1, 2), (10, 2, 0, 0, 9), (10, 6, 0, 0, 9),
        (11, 7, 0, 0, 2), (12, 7, 0, 5, 7),
    ]
    assert sorted(r.doc_id for r in D.decontaminated(docs, benchmark).collect()) == [2, 4, 6, 7, 8, 9]


def test_a_budget_beyond_the_lemma_is_an_error(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, "an item of more than twenty-four characters")], "item_id bigint, text string")
    with pytest.raises(ValueError, match="budget"):
        D.matches(docs, benchmark, budget=0.5)

import hashlib
from collections import defaultdict

import pytest

from meterbook.llm.exact_dedup import decisions, deduplicate, ranges

SCHEMA = "doc_id bigint, text string, digest string, row string, maybe boolean"
ROWS = [
    (1, "same", "x", "r", True),
    (2, "same", None, "r", None),
    (3, "other", "x", None, False),
    (4, None, "x", "r", True),
    (5, "", "x", "r", True),
    (None, "same", "x", "r", True),
    (None, None, "x", "r", True),
    (6, "long " * 50_000, "x", "r", True),
    (7, "long " * 50_000, "x", "r", True),
    (8, "unique", "x", "r", True),
] + [(100 + i, "hot", None, None, None) for i in range(50)]


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, best, len(ids), i == best, sha) for i in ids]
    return sorted(out, key=repr)


# 65536 bits are one filter; 128 bits a filter for every eight rows
@pytest.mark.parametrize("max_bits", [1 << 16, 1 << 7])
def test_decisions(spark, max_bits):
    rows = ROWS + [ROWS[2]]
    got = decisions(spark.createDataFrame(rows, SCHEMA), max_bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


@pytest.mark.parametrize("max_bits", [1 << 16, 1 << 7])
def test_rows_that_stay_keep_their_columns(spark, max_bits):
    got = deduplicate(spark.createDataFrame(ROWS + [ROWS[7]], SCHEMA), max_bits)
    assert got.columns == ["doc_id", "text", "digest", "row", "maybe"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [ROWS[1], ROWS[2], ROWS[4], ROWS[8], ROWS[9], ROWS[-1]], key=repr
    )


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert decisions(empty).collect() == [] and deduplicate(empty).collect() == []


def test_ranges_meet_and_cover_all_hashes():
    for rows, n in ((0, 1), (4096, 1), (4097, 2), (8 * 4096, 8)):
        found = ranges(rows, 1 << 16)
        assert len(found) == n and found[0][0] == -(1 << 63) and found[-1][1] == (1 << 63) - 1
        assert all(a[1] + 1 == b[0] for a, b in zip(found, found[1:]))


def test_filters_of_many_ranges_let_few_rows_shuffle(spark, monkeypatch):
    """32,000 different texts and eight filters of 2^16 bits: no more chance hits than with one large filter."""
    from meterbook.llm import exact_dedup

    seen = []
    groups = exact_dedup._groups
    monkeypatch.setattr(exact_dedup, "_groups", lambda met: seen.append(met.count()) or groups(met))
    docs = spark.range(32_000).selectExpr("id AS doc_id", "concat('text ', id % 31900) AS text")
    got = decisions(docs, 1 << 16)
    assert got.where("kept").count() == 31_900 and got.where("group_size = 2").count() == 200
    assert 200 <= seen[0] < 32_000 // 20

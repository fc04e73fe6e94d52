import random

import pytest

import corpus_pipeline
from meterbook.llm import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, labels, kind = [], [], {}

    def add(name, text):
        i = len(rows)
        rows.append((i, text, "en", f"src{i % 3}" if i % 7 else None, len(text or "")))
        kind.setdefault(name, []).append(i)
        return i

    items = [(i, prose(40)) for i in range(12)]
    for i in range(500):
        add("clean", prose(rng.randrange(30, 90)))
    for i in range(160):
        words = prose(60).split()
        for _ in range(2):
            words.insert(rng.randrange(60), rng.choice(["zzvile", "qqawful"]))
        add("toxic", " ".join(words))
    for i in range(30):
        text = prose(50)
        add("copied", text)
        add("copy", text)
    for i in range(30):
        words = prose(100).split()
        add("near first", " ".join(words))
        words[rng.randrange(100)] = "changed"
        add("near copy", " ".join(words))
    for _, item in items:
        add("leak", prose(20) + " " + item.replace("a", "a", 1) + " " + prose(20))
    for text in (None, "", " \n"):
        add("blank", text)
    for name, ids in kind.items():
        labels += [(i, 1, int(name == "toxic")) for i in ids if i % 2]
    folder = str(tmp_path_factory.mktemp("sf"))
    save = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    save(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint", "documents")
    save(labels, "doc_id bigint, quality int, toxic int", "labels")
    save(items, "item_id bigint, text string", "benchmark")
    return folder, kind, {r[0]: r for r in rows}


def test_every_stage_takes_out_what_it_should(spark, tables):
    folder, kind, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, set(rows)
    gone = {
        "toxicity": set(kind["toxic"]),
        # blank texts differ from each other but for null and empty
        "exact dedup": set(kind["copied"]) | {kind["blank"][0]},
        "n-gram Jaccard join": set(kind["near copy"]),
        "benchmark decontamination": set(kind["leak"]),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        left -= gone[name]
        got = docs.collect()
        assert docs.columns == columns
        assert sorted(map(tuple, got)) == sorted(rows[i] for i in left), name
        docs = spark.createDataFrame(got, docs.schema)
    name, stage = corpus_pipeline.STAGES[-1]
    mix = stage(spark, docs, folder)
    assert mix.columns == [*columns, "copies"]
    got = mix.collect()
    assert all(tuple(r)[:-1] == rows[r.doc_id] and r.copies in (1, 2) for r in got)
    assert {r.doc_id for r in got} <= left
    size = lambda i: len((rows[i][1] or "").split())
    total = sum(map(size, left))
    assert abs(sum(r.copies * size(r.doc_id) for r in got) - 1.5 * total) < 0.02 * total
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, got))


def test_registered_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= names and set(entry.oracle_sql()) <= names

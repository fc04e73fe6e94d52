"""JSON documents in parts, and lines of every length by one rule."""

import datetime
import json
import random

import pytest
from meterbook.functions import jsonprobe as J
from meterbook.operators import carry as C
from meterbook.sources import gemini, jsonfile
from pyspark.sql import functions as F

WORDS = ("usageMetadata",)


def documents():
    """Texts by name, with the values of logs; None for a file that is none."""
    rng = random.Random(6)
    usage = lambda n: {"id": f"e{n}", "usageMetadata": {"promptTokenCount": n}, "note": rng.choice(NOTES)}
    out = {}
    for k in range(12):
        items = [rng.choice([None, usage(n), usage(n), {"a": [{"b": {}}, [1, [2]], {}]}, {}]) for n in range(rng.choice([0, 1, 5, 40]))]
        text = json.dumps(items, indent=rng.choice([None, 1, "\t"]), ensure_ascii=rng.random() < 0.5)
        out[f"array{k}"] = text + rng.choice(["", "\n", " \r\n"])
        out[f"object{k}"] = rng.choice(["", "\n "]) + json.dumps(usage(k), indent=rng.choice([None, 2])) + rng.choice(["", "\n"])
    bad = {
        "scalars": '[{"id":1,"usageMetadata":{}}, 5]', "nested": '[[{"usageMetadata":{}}]]', "string": '["usageMetadata}", {}]',
        "tail": '[{"usageMetadata":{}}] x', "twice": '[{"usageMetadata":{}}][{}]', "no comma": '[{"usageMetadata":{}} {}]',
        "comma": '[{"usageMetadata":{}},]', "two commas": '[{},,{"usageMetadata":{}}]', "open": '[{"usageMetadata":{}}',
        "open element": '[{"usageMetadata":{}}, {"a":', "wrong bracket": '[{"usageMetadata":1], {"b":2}]', "bare": 'usageMetadata',
        "object tail": '{"usageMetadata":{}} x', "objects": '{"usageMetadata":{}}{}', "open object": '{"usageMetadata":{"a":1}',
        "bad number": '[{"usageMetadata":{}}, {"a":01}]', "empty": "", "blank": " \n", "brace": "}", "closed early": '{"usageMetadata":{}}}',
    }
    return out, bad


NOTES = ['a } b', '"quoted" \\ } {', "[{", "}]", "", "ünï}", "\n}", "\\", '\\"}', "x" * 50]


def test_elements_equal_a_parser(spark, staging, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 7)
    good, bad = documents()
    df = spark.createDataFrame(list((good | bad).items()), "file_path string, value string").repartition(5)
    values, refused = jsonfile.values(jsonfile.fragments_of(df), WORDS, staging)
    got = {}
    for r in values.collect():
        got.setdefault(r.file_path, {})[r.line_number] = r.value
    for name, text in good.items():
        parsed = json.loads(text)
        items = parsed if isinstance(parsed, list) else [parsed]
        want = {n: v for n, v in enumerate(items, 1) if v is not None}
        assert {n: json.loads(v) for n, v in got.get(name, {}).items()} == want, name
        assert all(v.strip() in text for v in got.get(name, {}).values())
    told = {r.file_path: r.has_words for r in refused.collect()}
    unparsed = {"wrong bracket", "bad number"}  # the structure is right, an element is not
    assert set(told) == set(bad) - unparsed
    assert not told["empty"] and not told["blank"] and not told["brace"] and told["tail"] and told["open object"]


def test_files_in_many_splits(spark, staging, tmp_path):
    good, bad = documents()
    big = json.dumps([{"id": f"b{n}", "usageMetadata": {"promptTokenCount": n}, "note": "} [" * 40} for n in range(300)])
    texts = good | bad | {"big": big, "mark": "﻿" + big}
    for k, text in enumerate(texts.values()):
        (tmp_path / f"{k}.json").write_text(text, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        fragments = jsonfile.scan_fragments(spark, [str(tmp_path)], ".json", None, staging)
        assert fragments.select(F.count(F.lit(1))).first()[0] > 600
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = spark.createDataFrame([(f"{tmp_path}/{k}.json", t.removeprefix("﻿")) for k, t in enumerate(texts.values())],
                                  "file_path string, value string")
    results = []
    for parts in (fragments, jsonfile.fragments_of(whole)):
        told = []
        rows = gemini.extract_fragments(parts, staging, told)
        lines = told[0].unionByName(told[1]) if len(told) > 1 else told[0]
        results.append((sorted(map(tuple, rows.select("source_file", "line_number", "native_event_id", "raw_sha256").collect())),
                        sorted(map(str, lines.collect()))))
    assert results[0] == results[1]
    names = {f"{tmp_path}/{k}.json": name for k, name in enumerate(texts)}
    by_file = {}
    for path, line, *_ in results[0][0]:
        by_file.setdefault(names[path], []).append(line)
    assert by_file["big"] == by_file["mark"] == list(range(1, 301))
    assert not set(by_file) & set(bad)
    refused = {names[t.split("file_path='")[1].split("'")[0]] for t in results[0][1]}
    assert refused == {n for n, t in bad.items() if "usageMetadata" in t}


def test_many_small_files_are_few_tasks(spark, staging, tmp_path):
    for k in range(60):
        (tmp_path / f"{k}.json").write_text(json.dumps([{"id": f"{k}-{n}", "usageMetadata": {"promptTokenCount": n}} for n in range(k)]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        fragments = jsonfile.scan_fragments(spark, [str(tmp_path)], ".json", None, staging)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    written = spark.read.option("recursiveFileLookup", True).parquet(f"{staging.root}/fragments-*").inputFiles()
    assert 0 < len(written) <= spark.sparkContext.defaultParallelism
    rows = gemini.extract_fragments(fragments, staging).select("source_file", "line_number", "native_event_id").collect()
    want = [(f"{tmp_path}/{k}.json", n + 1, f"{k}-{n}") for k in range(60) for n in range(k)]
    assert sorted(map(tuple, rows)) == sorted(want)


@pytest.mark.parametrize("advisory", ["64MB", "1KB"])
def test_documents_of_every_size_has_one_file_per_name(spark, tmp_path, advisory):
    import __spark_entry__ as E

    start = datetime.datetime(2024, 1, 1)
    events = [(n, start + datetime.timedelta(seconds=n), n % 29, "signup" if n % 3 else "view", n / 7, f'{{"k": {n % 90}}}') for n in range(3000)]
    df = spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": advisory, "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
                "spark.sql.shuffle.partitions": "16"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        got = E.queries()["documents_of_every_size"](spark, str(tmp_path)).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    signups = [e for e in events if e[3] == "signup"]
    want = [("broken", None, "not_a_json_object", None)] + [("all", n, "record", str(e[0])) for n, e in enumerate(signups, 1)]
    for user in range(29):
        want += [(str(user), n, "record", str(e[0])) for n, e in enumerate((e for e in signups if e[2] == user), 1)]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:4]) for r in got)


ODD = [
    '{"response":"x","usageMetadata":{"promptTokenCount":1}}', '{"usageMetadata":{"promptTokenCount":2}} x', '{"id":"a"},{"id":"b"}',
    '{"id":"a"}] [', '{"id":"a"}]', '{"id":"a"},"w":{}', "{'id':'a'}", '{"id":NaN}', '{"id":"a","id":"b"}', '{"id":1e400}', " {} ",
    '{"response":{"usageMetadata":5,"id":"r"},"id":7}', '{"metadata":[1],"model":"m"}', "[]", "null", "", '"{}"', '{"id":"a"', '{"a":{"b":[{"c":1}]},"id":"z"}',
    '{"id":"a"}\t', '{"id":"\\ud83d"}', '{"timestamp":1704164645,"usageMetadata":{"totalTokenCount":"5"}}', '{"id":01}', '{id:1}', '{"id":"a}]"}',
]


def test_long_lines_follow_the_rule_of_short_ones(spark, monkeypatch):
    lines = spark.createDataFrame([(n, v) for n, v in enumerate(ODD)], "n int, value string")

    def read():
        return {r.n: r.doc for r in J.read(lines, gemini.SHAPE).select("n", F.to_json("doc").alias("doc")).collect()}

    short = read()
    monkeypatch.setattr(J, "LONG_LINE", -1)
    assert read() == short
    assert short[0] is not None and short[1] is None


@pytest.mark.parametrize("padding", [0, 9_000_000])
def test_lines_with_padding(spark, staging, lines_of, padding):
    note = "x" * padding
    rows = [
        {"response": "x", "id": "a", "usageMetadata": {"promptTokenCount": 3}, "note": note},
        json.dumps({"id": "b", "usageMetadata": {"promptTokenCount": 3}, "note": note}) + " tail",
        {"id": "c", "note": note, "response": {"usageMetadata": {"promptTokenCount": 4}}},
    ]
    told = []
    got = gemini.extract(lines_of({"/g/a.jsonl": rows}), staging, None, told).collect()
    assert sorted(r.native_event_id for r in got) == ["a", "c"]
    assert [r.line_number for r in told[0].collect()] == [2]

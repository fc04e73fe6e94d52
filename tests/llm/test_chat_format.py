import hashlib
import json
from itertools import product

import pytest

from meterbook.llm import chat_format as C

PARTS = ["<|im_start|>", "<|im_end|>", "<|", "<||", "|", "<", "\n", "assistant", "é", "<|n>"]


def test_every_text_and_role_comes_back(spark):
    texts = ["".join(p) for n in range(3) for p in product(PARTS, repeat=n)]
    rows = [(1, i, role, t) for i, (role, t) in enumerate((r, t) for t in texts for r in ("assistant", t))]
    pieces = C.formatted(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    whole = "".join(r.piece for r in C.in_order(pieces).collect())
    assert list(C.read_turns(whole)) == [(r[2], r[3]) for r in rows]
    got = C.read_back(pieces).first()
    said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
    learned = "".join(t for _, _, r, t in rows if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert tuple(got) == (1, len(rows), sha(said), len(learned), sha(learned), len(whole))


def test_nulls_repeats_and_long_conversations(spark):
    rows = [(None, None, None, None)] * 2 + [(2**60 + 1, 0, "user", "x" * 300_000), (5, 1, "assistant", None)]
    rows += [(7, i, "assistant", f"t{i}") for i in range(3000)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    table = table.selectExpr("*", "'x' AS piece", "1 AS loss_start").repartition(7)
    got = {r.conv_id: r for r in C.read_back(C.formatted(C.turns_of_table(table))).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {None: 2, 2**60 + 1: 1, 5: 1, 7: 3000}
    assert got[7].loss_sha256 == hashlib.sha256("".join(f"t{i}" for i in range(3000)).encode()).hexdigest()
    assert got[5].loss_chars == 0 and got[None].loss_chars == 0
    assert C.read_back(C.formatted(C.turns_of_table(table.limit(0)))).collect() == []


RECORDS = [
    {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
    {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "id": 9},
    {"prompt": "a", "response": "b", "meta": {"x": [1, 2]}},
    {"prompt": "a", "completion": "b"},
    {"instruction": "a", "output": "b"},
    {"question": "a", "answer": "b"},
]


def test_layouts_of_json_records(spark):
    odd = [None, "not json", "[1]", json.dumps({"title": "x"}), json.dumps({"messages": [7]})]
    rows = [(i, json.dumps(r)) for i, r in enumerate(RECORDS)] + [(100 + i, r) for i, r in enumerate(odd)]
    got = C.turns_of_json(spark.createDataFrame(rows, "record_id bigint, record string")).collect()
    for i in range(len(RECORDS)):
        assert [(r.role, r.text) for r in got if r.conv_id == i] == [("user", "a"), ("assistant", "b")]
    assert sorted((r.conv_id, r.turn) for r in got if r.layout is None) == [(100 + i, None) for i in range(5)]


def test_layouts_of_tables(spark):
    listed = spark.createDataFrame(
        [(1, [("user", "a"), ("assistant", "b")])], "conv_id int, messages array<struct<role string, content string>>"
    )
    flat = spark.createDataFrame([(1, "s", "a", "b", 4)], "conv_id int, system string, prompt string, response string, n int")
    assert [(r.role, r.text) for r in C.turns_of_table(listed).collect()] == [("user", "a"), ("assistant", "b")]
    assert [r.role for r in C.turns_of_table(flat).orderBy("turn").collect()] == ["system", "user", "assistant"]
    with pytest.raises(ValueError):
        C.turns_of_table(spark.range(1))


def test_fields_of_other_layouts_do_not_void_a_record(spark):
    pair, listed = [("user", "a"), ("assistant", "b")], [{"role": "user", "content": "a"}, {"role": "bot", "content": "b"}]
    first = [("system", "s")]
    cases = [
        ({"instruction": "a", "output": "b", "system": "s"}, "system_instruction", first + pair),
        ({"messages": listed, "system": "s"}, "system_role_content", first + pair),
        ({"messages": listed, "prompt": "p"}, "role_content", pair),
        ({"question": "a", "answer": "b", "output": "c", "text": "t"}, "question_answer", pair),
        ({"instruction": "a", "input": "i", "output": "b", "prompt": "p"}, "instruction_input", [pair[0], ("user", "i"), pair[1]]),
        ({"messages": [], "prompt": "p"}, "role_content", []),
        ({"conversations": None}, "from_value", []),
        ({"messages": [], "system": "s"}, "system_role_content", first),
        ({"role": "bot", "text": None, "output": "x"}, "turn_rows", [("bot", "")]),
        ({"system": "s"}, None, []),
    ]
    rows = [((i, "k"), json.dumps(r)) for i, (r, _, _) in enumerate(cases)]
    records = spark.createDataFrame(rows, "record_id struct<n:int,k:string>, record string")
    got = C.turns_of_json(records).orderBy("conv_id.n", "turn").collect()
    for i, (_, layout, turns) in enumerate(cases):
        mine = [r for r in got if r.conv_id.n == i]
        assert {r.layout for r in mine} == {layout}, i
        assert [(r.role, r.text) for r in mine if r.turn is not None] == turns, i
        assert len(mine) == max(len(turns), 1)


def test_tables_with_columns_of_other_layouts(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", "p", "s")], "conv_id int, turn int, role string, text string, prompt string, system string")
    assert [tuple(r) for r in C.turns_of_table(rows).collect()] == [(1, 0, "user", "a", "turn_rows")]
    kind = "conv_id int, system string, messages array<struct<role string, content string>>"
    listed = spark.createDataFrame([(1, "s", [("user", "a"), ("bot", "b")]), (2, None, None)], kind)
    got = [(r.conv_id, r.turn, r.role, r.text) for r in C.turns_of_table(listed).orderBy("conv_id", "turn").collect()]
    assert got == [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 0, "system", None)]
    bare = listed.drop("system").where("conv_id = 2")
    assert [tuple(r) for r in C.turns_of_table(bare).collect()] == [(2, None, None, None, "role_content")]


def test_records_of_the_query_give_the_turns_of_the_table(spark):
    from meterbook.llm.queries import _chat_records

    rows = [(c, t, r, x) for c in range(6) for t, (r, x) in enumerate([("user", "a\u2028\n\"<|"), ("human", None), (None, "é𝄞"), ("assistant", "")])]
    table = spark.createDataFrame(rows * 2, "conv_id bigint, turn bigint, role string, text string")
    found = C.turns_of_json(_chat_records(table))
    assert found.select("layout").distinct().count() == 3
    turns = found.select("conv_id.conv_id", "conv_id.turn", "role", "text")
    want = {tuple(r) for r in C.read_back(C.formatted(C.turns_of_table(table))).collect()}
    assert {tuple(r) for r in C.read_back(C.formatted(turns)).collect()} == want

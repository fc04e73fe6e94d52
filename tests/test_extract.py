"""Extraction cases per log family."""

import json

import pytest
from meterbook.sources import claude, copilot, gemini, workbuddy

U = "gen_ai.usage."


def by_line(df):
    return {r.line_number: r for r in df.collect()}


def test_claude_shapes(lines_of):
    path = "/h/projects/team/app/s9/log.jsonl"
    rows = by_line(
        claude.extract(
            lines_of(
                {
                    path: [
                        {"timestamp": "2024-01-02T03:04:05Z", "sessionId": "S", "requestId": "r", "cwd": "/w",
                         "message": {"id": "m", "model": "x", "usage": {"input_tokens": 1.9, "output_tokens": "7", "speed": "fast"}}},
                        {"message": {"model": "y"}, "uuid": "u", "usage": {"input_tokens": 2}, "timestamp": 1704164645},
                        {"data": {"message": {"requestId": "q", "isSidechain": True, "timestamp": 1704164645000,
                                              "message": {"model": "z", "usage": {"output_tokens": 3}}}}},
                        '{"message":{"id":"a","usage":{"input_tokens":1}},"cwd":null}',
                        '{"message":{"id":"a","usage":{"input_tokens":1}}} {}',
                        '{"message":{"id":"a","usage":{"input_tokens":1}}}] {}',
                        {"message": {"id": "s", "model": "<synthetic>", "usage": {"input_tokens": 0}}},
                        {"message": {"id": "s", "model": "<synthetic>", "usage": {"input_tokens": 4}}},
                        '{"message":{"id":"1","id":"2","usage":{"input_tokens":true,"output_tokens":1}}}',
                        {"message": "usage"},
                        '{"message":{"id":"e","us\\u0061ge":{"input_tokens":6}}}',
                    ]
                }
            )
        )
    )
    assert sorted(rows) == [1, 2, 3, 8, 9, 11]
    assert (rows[1].model, rows[1].input_tokens, rows[1].output_tokens) == ("x-fast", 1, 0)
    assert (rows[1].identity_subkey, rows[1].project_path, rows[1].native_session_id) == ("m:r", "/w", "S")
    assert (rows[2].native_event_id, rows[2].timestamp_ms, rows[2].session_id) == ("u", 1704164645000, "s9")
    assert rows[2].project_path == "team/app" and rows[2].session_path_id == "projects/team/app/s9/log.jsonl"
    assert (rows[3].identity_kind, rows[3].native_event_id, rows[3].is_sidechain) == ("request", "q", True)
    assert rows[3].identity_subkey is None and rows[8].model is None
    assert (rows[9].message_id, rows[9].input_tokens, rows[9].output_tokens) == ("2", 0, 1)
    assert rows[11].input_tokens == 6


@pytest.mark.parametrize(
    "path, session, project",
    [
        ("/h/projects/p/a.jsonl", "a", "p"),
        ("/h/projects/p/s/a.jsonl", "s", "p"),
        ("/h/projects/p/q/s/a.jsonl", "s", "p/q"),
        ("/h/projects/p/s/subagents/a.jsonl", "s", "p"),
        ("/h/projects/a.jsonl", "projects", "a.jsonl"),
        ("/h/else/a.jsonl", "else", None),
    ],
)
def test_claude_paths(lines_of, path, session, project):
    row = claude.extract(lines_of({path: [{"message": {"usage": {"input_tokens": 1}}}]})).first()
    assert (row.session_id, row.project_path) == (session, project)


def test_gemini_lines_and_documents(spark, lines_of, staging):
    row = gemini.extract(
        lines_of(
            {
                "/h/.gemini/x.jsonl": [
                    {"response": {"usageMetadata": {"prompt_token_count": " 12 ", "toolUsePromptTokenCount": 3,
                                                    "cached_content_token_count": 20, "total_token_count": "1.9"},
                                  "request_id": "r", "timestamp": "2024-01-02T03:04:05Z"}}
                ]
            }
        )
    ).first()
    assert (row.input_tokens, row.raw_input_tokens, row.cache_read_tokens) == (-5, 15, 20)
    assert (row.native_event_id, row.identity_kind, row.source_total_tokens) == ("r", "request", None)
    docs = spark.createDataFrame(
        [
            ("/g/one.json", ' {"usageMetadata": {"promptTokenCount": 1},\n "id": "o"}\n'),
            ("/g/many.json", '[{"usageMetadata":{"promptTokenCount":2}}, null, {"usageMetadata":{}}]'),
            ("/g/mixed.json", '[{"usageMetadata":{"promptTokenCount":2}}, 5]'),
            ("/g/broken.json", '{"usageMetadata":'),
        ],
        "file_path string, value string",
    )
    got = sorted((r.source_file, r.line_number, r.identity_subkey) for r in gemini.extract_documents(docs, staging).collect())
    assert got == [
        ("/g/many.json", 1, "line:1"),
        ("/g/many.json", 3, "line:3"),
        ("/g/one.json", 1, None),
    ]


def buddy(id="i", **changes):
    raw = {"prompt_tokens": 10, "completion_tokens": 4, "total_tokens": 14, **changes.pop("raw", {})}
    data = {"model": "m", "usage": {"requests": 1}, "rawUsage": raw, **changes.pop("data", {})}
    return {"id": id, "timestamp": 1704164645, "sessionId": "s", "cwd": "/c", "providerData": data, **changes}


def test_workbuddy_reasons(lines_of):
    lines = lines_of(
        {
            "/w/a.jsonl": [
                buddy(),
                "{",
                {"other": 1},
                buddy(timestamp=1.5),
                buddy(data={"usage": {"requests": 2}}),
                buddy(raw={"total_tokens": 15}),
                buddy(raw={"prompt_tokens": 10.0}),
                buddy(raw={"prompt_tokens_details": {"cached_tokens": 11}}),
                buddy(raw={"completion_tokens_details": {"reasoning_tokens": 5}}),
                buddy(data={"model": "auto", "requestModelId": "custom-local:x"}),
                {"providerData": {"model": "m"}},
            ]
        }
    )
    records, refused = workbuddy.extract(lines)
    assert {r.line_number: r.reason for r in refused.collect()} == {
        2: "invalid_json",
        4: "missing_required_fields",
        5: "invalid_usage_multiplicity",
        6: "invalid_token_totals",
        7: "invalid_token_totals",
        8: "invalid_token_details",
        9: "invalid_token_details",
    }
    rows = by_line(records)
    assert sorted(rows) == [1, 10] and rows[1].observability_level == "partial"
    assert (rows[10].model_normalized, rows[10].provider, rows[10].model_is_fallback) == ("unknown", "custom", True)
    note = workbuddy.summarize_refused(refused).first()
    assert note.total == 7 and note.samples.count("line") == 5 and note.warning.endswith("... 2 more")


def test_copilot_spans(lines_of, staging):
    both = {"traceId": "t", "spanId": "s", "timestamp": "2024-01-02T03:04:05Z"}
    lines = lines_of(
        {
            "/h/.copilot/otel/a.jsonl": [
                {**both, "name": "agent turn", "attributes": {U + "input_tokens": 50, U + "output_tokens": 50}},
                {**both, "name": "chat", "attributes": [
                    {"key": U + "input_tokens", "value": {"intValue": "10"}},
                    {"key": U + "cache_read.input_tokens", "value": {"intValue": "30"}},
                    {"key": "gen_ai.request.model", "value": {"stringValue": "g"}}]},
                {"attributes": {U + "prompt_tokens": 5}, "resource": {"attributes": {U + "prompt_tokens": 6}},
                 "scope": {"attributes": {"session.id": "se"}}, "events": [{"name": "x", "attributes": {U + "output_tokens": 2}}, 7]},
                {"attributes": {U + "total_tokens": "9", "gen_ai.request.id": "rq"}, "timeUnixNano": "1704164645000000000"},
                {"attributes": {"other": 1}},
            ]
        }
    )
    rows = {(r.line_number, r.order_key.part): r for r in copilot.extract(lines, staging).collect()}
    assert sorted(rows) == [(2, 0), (3, 0), (3, 1), (4, 0)]
    chat = rows[(2, 0)]
    assert (chat.input_tokens, chat.cache_read_tokens, chat.raw_input_tokens, chat.model) == (0, 10, 10, "g")
    assert (rows[(3, 0)].input_tokens, rows[(3, 0)].identity_subkey) == (6, "line:3|root")
    assert (rows[(3, 1)].output_tokens, rows[(3, 1)].identity_subkey) == (2, "line:3|event:0")
    total = rows[(4, 0)]
    assert (total.total_tokens, total.observability_level, total.identity_kind) == (9, "inferred", "request")
    assert total.timestamp_ms == 1704164645000


def test_copilot_sessions(lines_of, staging):
    def shutdown(**more):
        metrics = {"gpt-4.1": {"usage": {"inputTokens": 10, "cacheReadTokens": 4}}, "idle": {"usage": {}}, "bad": 3}
        return {"type": "session.shutdown", "timestamp": "2024-01-02T03:04:05Z",
                "data": {"modelMetrics": metrics, **more.pop("data", {})}, **more}

    path = "/h/.copilot/session-state/dir/events.jsonl"
    start = {"type": "session.start", "data": {"sessionId": "S", "context": {"cwd": "/a"}}}
    moved = {"type": "session.context_changed", "data": {"gitRoot": "/b"}}
    lines = lines_of({path: [shutdown(), start, shutdown(id="sd"), moved, shutdown(data={"sessionId": "D"})]})
    rows = by_line(copilot.extract(lines, staging))
    assert sorted(rows) == [1, 3, 5]
    assert (rows[1].native_session_id, rows[1].session_id, rows[1].project_path) == (None, "dir", None)
    assert (rows[3].native_session_id, rows[3].native_event_id, rows[3].identity_subkey) == ("S", "sd", "gpt-4.1")
    assert rows[3].project_path == "/a" and rows[3].input_tokens == 6 and rows[3].total_tokens == 10
    assert (rows[5].native_session_id, rows[5].project_path) == ("D", "/b")
    assert rows[5].identity_subkey == "line:5|gpt-4.1"


def test_documents_of_a_large_user_stay_small(spark, monkeypatch):
    import __spark_entry__ as E

    numbers = [1, 8, 20_000, 20_001, 45_001, 45_002]
    rows = [
        (f"/home/.gemini/tmp/{who}.jsonl", n, json.dumps({"eventId": f"{who}-{n}", "usageMetadata": {"promptTokenCount": n}}))
        for who in ("a", "b")
        for n in numbers
    ]
    logs = spark.createDataFrame(rows, "file_path string, line_number bigint, value string")
    monkeypatch.setattr(E.V, "gemini_lines", lambda *_: logs)
    documents, extract = [], gemini.extract_documents

    def extracted(whole, *rest):
        documents.extend(len(json.loads(r.value)) for r in whole.collect())
        return extract(whole, *rest)

    monkeypatch.setattr(E.gemini, "extract_documents", extracted)
    got = E._gemini_documents(spark, "").select("source_file", "line_number", "native_event_id").collect()
    assert sorted(documents) == [1, 1, 2, 2, 3, 3]
    assert sorted(map(tuple, got)) == [
        (f"/home/.gemini/tmp/{who}.json", n, f"{who}-{i}") for who in ("a", "b") for n, i in enumerate(numbers, 1)
    ]

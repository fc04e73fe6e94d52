"""Raw log lines derived from the given tables, for the extractors and the ordered chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from testviews import view

LINE_COLUMNS = ("file_path", "line_number", "value")


def rfc3339(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _channel(spark: SparkSession, sf_dir: str, channel: str) -> DataFrame:
    rows = view(spark, sf_dir, "ledger").where(F.col("channel") == channel)
    return rows.withColumn("n", F.col("event_id").cast("bigint")).withColumn(
        "user", F.regexp_extract("session_key", r"^s-(\d+)-", 1)
    )


def _lines(rows: DataFrame, path: Column, body: Column) -> DataFrame:
    return rows.select(
        path.alias("file_path"), (F.col("n") + 1).alias("line_number"), F.to_json(body).alias("value")
    )


def claude_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _channel(spark, sf_dir, "claude")
    usage = F.struct(
        "input_tokens",
        "output_tokens",
        F.col("cache_creation_tokens").alias("cache_creation_input_tokens"),
        F.col("cache_read_tokens").alias("cache_read_input_tokens"),
    )
    message = F.struct(
        F.col("message_id").alias("id"), F.col("model_raw").alias("model"), usage.alias("usage")
    )
    body = F.struct(
        rfc3339(F.col("timestamp_ms")).alias("timestamp"),
        F.col("session_id").alias("sessionId"),
        F.concat(F.lit("req-"), F.col("event_id")).alias("requestId"),
        F.col("project_path").alias("cwd"),
        message.alias("message"),
    )
    path = F.concat(F.lit("/logs/projects/p"), F.col("user"), F.lit("/s"), F.col("user"), F.lit("/a.jsonl"))
    return _lines(rows, path, body)


def gemini_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _channel(spark, sf_dir, "gemini")
    usage = F.struct(
        (F.col("input_tokens") + F.col("cache_read_tokens")).alias("promptTokenCount"),
        F.col("output_tokens").cast("string").alias("candidates_token_count"),
        F.col("cache_read_tokens").alias("cachedContentTokenCount"),
        F.col("reasoning_tokens").alias("thoughtsTokenCount"),
    )
    body = F.struct(
        F.col("event_id").alias("eventId"),
        F.col("session_id").alias("session_id"),
        F.col("timestamp_ms").alias("timestamp"),
        F.struct(F.col("model_raw").alias("model"), usage.alias("usageMetadata")).alias("response"),
    )
    return _lines(rows, F.concat(F.lit("/home/.gemini/tmp/"), F.col("user"), F.lit(".jsonl")), body)


def workbuddy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _channel(spark, sf_dir, "workbuddy")
    prompt = F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    # Every eleventh line has a wrong total, every thirteenth counts two requests.
    total = prompt + F.col("output_tokens") + F.when(F.col("n") % 11 == 0, 1).otherwise(0)
    raw = F.struct(
        prompt.alias("prompt_tokens"),
        F.col("output_tokens").alias("completion_tokens"),
        total.alias("total_tokens"),
        F.col("cache_creation_tokens").alias("prompt_cache_write_tokens"),
        F.struct(F.col("cache_read_tokens").alias("cached_tokens")).alias("prompt_tokens_details"),
        F.struct("reasoning_tokens").alias("completion_tokens_details"),
    )
    data = F.struct(
        F.coalesce("model_raw", F.lit("auto")).alias("model"),
        F.struct(F.when(F.col("n") % 13 == 0, 2).otherwise(1).alias("requests")).alias("usage"),
        raw.alias("rawUsage"),
    )
    body = F.struct(
        F.col("event_id").alias("id"),
        F.col("timestamp_ms").alias("timestamp"),
        F.coalesce("session_id", "session_key").alias("sessionId"),
        F.lit("/work").alias("cwd"),
        data.alias("providerData"),
    )
    return _lines(rows, F.concat(F.lit("/logs/projects/"), F.col("user"), F.lit(".jsonl")), body)


def copilot_span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes as a list for even events and as an object for odd ones; a second, poorer
    entry of the same request follows for every third event."""
    rows = _channel(spark, sf_dir, "copilot")
    rows = rows.withColumn(
        "copy", F.explode(F.when(F.col("n") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )
    first = F.col("copy") == 0
    values = {
        "gen_ai.usage.input_tokens": F.col("input_tokens") + F.col("cache_read_tokens"),
        "gen_ai.usage.output_tokens": F.when(first, F.col("output_tokens")).otherwise(0),
        "gen_ai.usage.cache_read.input_tokens": F.col("cache_read_tokens"),
        "gen_ai.usage.cache_creation.input_tokens": F.col("cache_creation_tokens"),
        "gen_ai.usage.reasoning.output_tokens": F.col("reasoning_tokens"),
    }
    texts = {
        "gen_ai.response.id": F.concat(F.lit("resp-"), F.col("event_id")),
        "gen_ai.response.model": F.col("model_raw"),
        "gen_ai.conversation.id": F.col("session_id"),
    }
    as_list = F.array(
        *[
            F.struct(
                F.lit(k).alias("key"),
                F.struct(v.cast("string").alias("intValue"), F.lit(None).cast("string").alias("stringValue")).alias("value"),
            )
            for k, v in values.items()
        ],
        *[
            F.struct(
                F.lit(k).alias("key"),
                F.struct(F.lit(None).cast("string").alias("intValue"), v.alias("stringValue")).alias("value"),
            )
            for k, v in texts.items()
        ],
    )
    as_object = F.struct(*[v.alias(k) for k, v in {**values, **texts}.items()])
    name = F.lit("chat completion").alias("name")
    stamp = F.concat((F.col("timestamp_ms")).cast("string"), F.lit("000000")).alias("timeUnixNano")
    body = F.when(
        F.col("n") % 2 == 0, F.to_json(F.struct(name, stamp, as_list.alias("attributes")))
    ).otherwise(F.to_json(F.struct(name, stamp, as_object.alias("attributes"))))
    return rows.select(
        F.concat(F.lit("/home/.copilot/otel/"), F.col("user"), F.lit(".jsonl")).alias("file_path"),
        (F.col("n") * 2 + F.col("copy") + 1).alias("line_number"),
        body.alias("value"),
    )


def copilot_session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user one session log: a start line, then one shutdown line per event."""
    rows = _channel(spark, sf_dir, "copilot")
    path = F.concat(
        F.lit("/home/.copilot/session-state/u"), F.col("user"), F.lit("/events.jsonl")
    ).alias("file_path")
    start = rows.select("user", path).distinct().select(
        "file_path",
        F.lit(1).cast("bigint").alias("line_number"),
        F.to_json(
            F.struct(
                F.lit("session.start").alias("type"),
                F.struct(
                    F.concat(F.lit("session-"), F.col("user")).alias("sessionId"),
                    F.struct(F.lit("/repo").alias("gitRoot")).alias("context"),
                ).alias("data"),
            )
        ).alias("value"),
    )
    usage = F.struct(
        (F.col("input_tokens") + F.col("cache_read_tokens")).alias("inputTokens"),
        F.col("output_tokens").alias("outputTokens"),
        F.col("cache_read_tokens").alias("cacheReadTokens"),
        F.col("cache_creation_tokens").alias("cacheWriteTokens"),
        F.col("reasoning_tokens").alias("reasoningTokens"),
    )
    metrics = F.create_map(F.col("model_normalized"), F.struct(usage.alias("usage")))
    shut = rows.select(
        path,
        (F.col("n") + 2).alias("line_number"),
        F.to_json(
            F.struct(
                F.lit("session.shutdown").alias("type"),
                rfc3339(F.col("timestamp_ms")).alias("timestamp"),
                F.struct(metrics.alias("modelMetrics")).alias("data"),
            )
        ).alias("value"),
    )
    return start.unionByName(shut)


def _usage_body(kind: str, ts: Column, counts: dict[str, Column]) -> Column:
    usage = F.struct(*[v.alias(k) for k, v in counts.items()])
    info = F.struct(usage.alias(kind))
    payload = F.struct(F.lit("token_count").alias("type"), info.alias("info"))
    return F.to_json(
        F.struct(F.lit("event_msg").alias("type"), rfc3339(ts).alias("timestamp"), payload.alias("payload"))
    )


# Start of the log of a conversation, one minute per turn.
def _turn_ms() -> Column:
    return F.lit(1_704_067_200_000) + F.col("conv_id") * 3_600_000 + F.col("line_number") * 60_000


def codex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative logs: per turn a model declaration (user turns), usage, and every second
    turn a completion marker."""
    rows = view(spark, sf_dir, "counters").withColumn("base", (F.col("line_number") - 1) * 3)
    turn = F.col("line_number") - 1
    declared = rows.where(F.col("role") == "user").select(
        "file_path",
        (F.col("base") + 1).alias("line_number"),
        F.to_json(
            F.struct(
                F.lit("turn_context").alias("type"),
                F.struct(F.concat(F.lit("m"), (turn % 3).cast("string")).alias("model")).alias("payload"),
            )
        ).alias("value"),
    )
    counts = {
        "input_tokens": F.col("total"),
        "output_tokens": F.col("output"),
        "reasoning_output_tokens": F.col("reasoning"),
        "total_tokens": F.col("total") + F.col("output"),
    }
    used = rows.select(
        "file_path",
        (F.col("base") + 2).alias("line_number"),
        _usage_body("total_token_usage", _turn_ms(), counts).alias("value"),
    )
    closed = rows.where(turn % 2 == 1).select(
        "file_path",
        (F.col("base") + 3).alias("line_number"),
        F.to_json(
            F.struct(
                F.lit("event_msg").alias("type"),
                F.struct(
                    F.lit("task_complete").alias("type"),
                    F.concat(F.lit("t"), turn.cast("string")).alias("turn_id"),
                ).alias("payload"),
            )
        ).alias("value"),
    )
    return declared.unionByName(used).unionByName(closed)


def fork_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parent log per conversation, and a forked child for every third one.

    The child replays the first ``conv_id % 4 + 1`` parent rows, then adds two of its own.
    ``conv_id % 5 = 0`` names a parent that does not exist; ``conv_id % 7 = 0`` replays in
    one burst. Copies keep the values, not the times.
    """
    rows = view(spark, sf_dir, "counters").withColumn("ts", _turn_ms())
    conv = F.col("conv_id").cast("string")
    single = {
        "input_tokens": F.col("n"),
        "output_tokens": F.col("n") % 97,
        "total_tokens": F.col("n") + F.col("n") % 97,
    }

    def meta(frame: DataFrame, path: Column, ts: Column, payload: Column) -> DataFrame:
        body = F.struct(
            F.lit("session_meta").alias("type"), rfc3339(ts).alias("timestamp"), payload.alias("payload")
        )
        return frame.select(
            path.alias("file_path"), F.lit(1).cast("bigint").alias("line_number"), F.to_json(body).alias("value")
        )

    parent_path = F.concat(F.lit("/logs/sessions/p"), conv, F.lit(".jsonl"))
    child_path = F.concat(F.lit("/logs/sessions/q"), conv, F.lit(".jsonl"))
    convs = rows.select("conv_id").distinct()
    start = F.lit(1_704_067_200_000) + F.col("conv_id") * 3_600_000
    parents = meta(
        convs, parent_path, start, F.struct(F.concat(F.lit("p"), conv).alias("id"))
    ).unionByName(
        rows.select(
            parent_path.alias("file_path"),
            (F.col("line_number") + 1).alias("line_number"),
            _usage_body("last_token_usage", F.col("ts"), single).alias("value"),
        )
    )
    forked = F.col("conv_id") % 3 == 0
    copies = F.col("conv_id") % 4 + 1
    fork_ts = start + copies * 60_000
    gap = F.when(F.col("conv_id") % 7 == 0, 400).otherwise(5_000)
    wanted = F.when(F.col("conv_id") % 5 == 0, F.lit("gone")).otherwise(F.lit("p"))
    children = meta(
        convs.where(forked),
        child_path,
        fork_ts,
        F.struct(
            F.concat(F.lit("q"), conv).alias("id"), F.concat(wanted, conv).alias("forked_from_id")
        ),
    )
    copied = rows.where(forked & (F.col("line_number") <= copies)).select(
        child_path.alias("file_path"),
        (F.col("line_number") + 1).alias("line_number"),
        _usage_body("last_token_usage", fork_ts + F.col("line_number") * gap, single).alias("value"),
    )
    own = convs.where(forked).withColumn("step", F.explode(F.array(F.lit(1), F.lit(2))))
    own_counts = {
        "input_tokens": F.lit(1_000_000) + F.col("step"),
        "output_tokens": F.lit(7),
        "total_tokens": F.lit(1_000_007) + F.col("step"),
    }
    added = own.select(
        child_path.alias("file_path"),
        (F.col("step") + 100).cast("bigint").alias("line_number"),
        _usage_body("last_token_usage", fork_ts + F.col("step") * 600_000, own_counts).alias("value"),
    )
    return parents.unionByName(children).unionByName(copied).unionByName(added)

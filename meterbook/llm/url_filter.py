"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A rule is a canonical URL key, host then path, like ``example.com/en/``. It covers its host and
every subdomain where the path starts with the rule's path. A URL therefore has one candidate
key for each (number of host labels, path length) that occurs among the rules: the last labels
of its host, followed by the start of its path. Candidates are tested against a blocked Bloom
filter (one 64-bit word per block, four bits set per key); only hits reach the exact join, which
removes the false positives. The longest matching key wins.

Everything is DataFrame work. The filter is collected as at most ``max_blocks`` longs (8 MiB, for
about ten million rules) and becomes one binary literal; a longer rule list shares the blocks and
lets more candidates through to the join, which stays exact. The rule list itself is joined by
Spark's own choice of strategy and is never broadcast by hint.

Defined cases: a null URL, or one without ``://``, has an empty host and path; a row without a
matching rule gets rule null and verdict ``allow``; rows that repeat are judged each; two rules
with the same key and different verdicts resolve to ``block``; a rule key without a slash has an
empty path; null rules are ignored and a null verdict means block. Columns of ``pages`` other than its id and URL are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
MAX_BLOCKS = 1 << 20
_PROBES = 4


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lowered) and path, both empty where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    has = F.instr(url, "://") > 0
    rest = F.when(has, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substr(rest, F.length(host) + 1)
    return _lower_ascii(host), F.regexp_extract(after, r"^[^?#]*", 0)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """Four of 64 bits, chosen by a second hash."""
    h = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("bigint")
    for i in range(_PROBES):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return mask


def rule_table(rules: DataFrame) -> DataFrame:
    """Distinct keys with their verdict and shape, from columns ``rule`` and ``verdict``."""
    key = _lower_ascii(F.regexp_extract("rule", r"^[^/]*", 0))
    path = F.substr(F.col("rule"), F.length(key) + 1)
    return (
        rules.where("rule IS NOT NULL")
        .select(
            F.concat(key, path).alias("rule"),
            F.coalesce("verdict", F.lit(BLOCK)).alias("verdict"),
            F.size(F.split(key, r"\.")).alias("labels"),
            F.length(path).alias("path_length"),
            F.length(key).alias("host_length"),
        )
        .groupBy("rule", "labels", "path_length", "host_length")
        .agg(F.max("verdict").alias("verdict"))
    )


def _filter_words(rules: DataFrame, blocks: int) -> Column:
    """The blocks of the Bloom filter, eight bytes each, as one literal."""
    words = bytearray(8 * blocks)
    rows = rules.groupBy(_block(F.col("rule"), blocks).alias("block")).agg(
        F.bit_or(_mask(F.col("rule"))).alias("word")
    )
    for r in rows.collect():  # at most one row per block
        words[8 * r.block : 8 * r.block + 8] = r.word.to_bytes(8, "big", signed=True)
    return F.lit(words)


def _may_be_listed(key: Column, words: Column, blocks: int) -> Column:
    word = F.hex(F.substr(words, _block(key, blocks) * 8 + 1, F.lit(8)))
    return F.conv(word, 16, -10).cast("bigint").bitwiseAND(_mask(key)) == _mask(key)


def _candidates(shapes: list, host: Column, path: Column) -> Column:
    """One key per shape that the URL can fill."""
    labels = F.size(F.split(host, r"\."))
    keys = [
        F.when(
            (host != "") & (labels >= s.labels) & (F.length(path) >= s.path_length),
            F.concat(F.substring_index(host, ".", -s.labels), F.substring(path, 1, s.path_length)),
        )
        for s in shapes
    ]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def verdicts(pages: DataFrame, rules: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``."""
    listed = rule_table(rules)
    shapes = listed.select("labels", "path_length").distinct().collect()
    blocks = min(max_blocks, max(8, 1 << (listed.count() // 4).bit_length()))
    words = _filter_words(listed, blocks)

    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    tested = read.withColumn(
        "hits",
        F.filter(
            _candidates(shapes, F.col("host"), F.col("path")),
            lambda k: _may_be_listed(k, words, blocks),
        ),
    )
    passed = tested.where(F.size("hits") == 0).select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(ALLOW).alias("verdict")
    )
    rank = F.struct(
        (F.col("host_length") + F.col("path_length")).alias("n"), "host_length", "rule", "verdict"
    )
    possible = tested.where(F.size("hits") > 0)
    best = (
        possible.withColumn("rule", F.explode("hits"))
        .join(listed, "rule", "left")
        .groupBy("page_id", "host", "path")
        .agg(
            F.max(F.when(F.col("verdict").isNotNull(), rank)).alias("best"),
            # every row brings as many joined rows as it has hits
            (F.count(F.lit(1)) / F.first(F.size("hits"))).cast("int").alias("copies"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    )
    return passed.unionByName(
        best.select(
            "page_id",
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce(F.col("best.verdict"), F.lit(ALLOW)).alias("verdict"),
        )
    )

"""JSON documents in parts: the elements of an array, without a file passing one task.

A file is read in fragments that end at a closing brace, which any split of it yields. What a
fragment does to the state of the text, from outside or inside a string, at some depth of brackets,
does not depend on its size, and the state at its begin is the sum over the fragments before it:
unescaped quotes tell whether it begins in a string, brackets outside strings tell the depth. Both
are running sums (``operators.carry``). A fragment that begins at depth 1 stands between two elements
of the array; what it has before its first brace is checked to be a separator, or the end.

An element is then the text of its fragments, as in the file, whatever the size of the array. Only
one object as a whole document, and one element, are ever put together in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterbook.operators import carry as C
from meterbook.session import Staging
from meterbook.sources import lines as L

_WHITE = "[ \\t\\r\\n]*"
_NULL = f"{_WHITE}null{_WHITE}"
#: What stands before the first element, between two, and around the end of an array.
_FIRST = rf"^{_WHITE}\[({_NULL},)*{_WHITE}\{{"
_NEXT = rf"^({_WHITE},{_NULL})*{_WHITE},{_WHITE}\{{"
_END = rf"^({_WHITE},{_NULL})*{_WHITE}\]{_WHITE}$"
_ONLY_NULLS = rf"^{_WHITE}\[({_NULL}(,{_NULL})*|{_WHITE})\]{_WHITE}$"

FRAGMENT = ("file_path", "no", "value", "closed")
#: Bytes of text that a task reads at least where splits are smaller.
TASK_BYTES = 32 << 20


def fragments_of(documents: DataFrame) -> DataFrame:
    """``file_path, no, value, closed`` from whole texts ``file_path, value``.

    ``closed`` tells whether a closing brace follows; it does not behind the last fragment.
    """
    parts = F.split("value", r"\}", -1)
    rows = documents.select("file_path", F.size(parts).alias("n"), F.posexplode(parts).alias("at", "value"))
    no = (F.col("at") + 1).cast("bigint")
    return rows.select("file_path", no.alias("no"), "value", (no < F.col("n")).alias("closed"))


def scan_fragments(spark: SparkSession, roots: list[str], suffix: str, before, staging: Staging) -> DataFrame:
    """The fragments of all files below the roots; the text is read once, in splits of any size.

    With the columns of ``_blocks``: the blocks of a file are its splits.
    """
    read = L.reader(spark, suffix, before).option("lineSep", "}").text(roots)
    raw = staging.put(
        _in_few_tasks(
            read.select(
                L.plain_path(F.col("_metadata.file_path")).alias("file_path"),
                F.col("_metadata.file_size").alias("file_size"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("seq"),
                _quotes(F.col("value")).alias("quotes"),
                "value",
            )
        ),
        "fragments",
    )
    cut = _in_few_tasks(raw).groupBy("file_path", "block").agg(
        F.min("seq").alias("first_seq"),
        F.count(F.lit(1)).alias("n"),
        F.sum("quotes").alias("quotes"),
        F.sum(F.octet_length("value").cast("bigint") + 1).alias("size"),
        F.max("file_size").alias("file_size"),
    )
    whole = Window.partitionBy("file_path")
    # Behind the last brace nothing is left as a fragment if the file ends there. Then, and only
    # then, the fragments with a brace each make up the whole file (but for a byte order mark).
    left = F.col("file_size") - F.sum("size").over(whole)
    cut = staging.put(
        cut.select(
            "file_path",
            "block",
            (_sum_before("n") - F.col("first_seq") + 1).alias("to_no"),
            _sum_before("quotes").alias("quotes_before"),
            F.when(left.isin(0, 3), 2**62).otherwise(F.sum("n").over(whole)).alias("open_no"),
        ),
        "splits",
    )
    rows = raw.drop("file_size").join(cut, ["file_path", "block"])
    no = F.col("seq") + F.col("to_no")
    closed = no < F.col("open_no")
    return rows.select("file_path", no.alias("no"), "value", closed.alias("closed"), "block", "quotes", "quotes_before")


def _in_few_tasks(read: DataFrame) -> DataFrame:
    """Rows of many small splits or files, several to a task; rows and their ids are those of the splits."""
    spark = read.sparkSession
    n, size = read.rdd.getNumPartitions(), L.split_bytes(spark)
    tasks = max(-(-n * size // TASK_BYTES), spark.sparkContext.defaultParallelism)
    return read.coalesce(tasks) if tasks < n else read


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _sum_before(name: str) -> Column:
    """Sum over the blocks of a file before this one."""
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(earlier), _zero())


def _count(text: Column, *marks: str) -> Column:
    """How often any of some characters of one byte occurs."""
    size = F.octet_length(text)
    return sum((size - F.octet_length(F.replace(text, F.lit(m))) for m in marks), F.lit(0)).cast("bigint")


def _bare(text: Column) -> Column:
    return F.when(text.contains("\\"), F.regexp_replace(text, r"(?s)\\.", "")).otherwise(text)


def _quotes(text: Column) -> Column:
    return _count(_bare(text), '"')


def _blocks(fragments: DataFrame, staging: Staging) -> DataFrame:
    """Fragments with ``block``, consecutive rows of a file, and ``quotes`` in and before the block."""
    if "quotes_before" in fragments.columns:
        return fragments
    block = C.block_of(F.col("no"), C.BLOCK_ROWS)
    rows = staging.put(fragments.select(*FRAGMENT, block.alias("block"), _quotes(F.col("value")).alias("quotes")), "quotes")
    sums = rows.groupBy("file_path", "block").agg(F.sum("quotes").alias("quotes"))
    entering = sums.select("file_path", "block", _sum_before("quotes").alias("quotes_before"))
    known = rows.join(entering, ["file_path", "block"], "left")
    return known.withColumn("quotes_before", F.coalesce("quotes_before", _zero()))


def _structure(fragments: DataFrame, staging: Staging) -> DataFrame:
    """Fragments with ``depth`` at their begin, the ``step`` from there, whether they begin ``outside``
    strings, and ``plain``: their text with every string as one quote.

    Sums inside a block need its rows only; what enters a block is one row of another table.
    """
    here = Window.partitionBy("file_path", "block").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    within = lambda name: F.coalesce(F.sum(name).over(here), _zero())
    placed = _blocks(fragments, staging).withColumn("quotes_before", F.col("quotes_before") + within("quotes"))
    inside = F.col("quotes_before") % 2 == 1
    bare = _bare(F.col("value"))
    text = F.when(inside, F.concat(F.lit('"'), bare)).otherwise(bare)
    ends_outside = (F.col("quotes_before") + F.col("quotes")) % 2 == 0
    known = placed.select(
        *FRAGMENT,
        "block",
        "quotes",
        (~inside).alias("outside"),
        F.when(F.col("closed") & ends_outside, 1).otherwise(0).alias("closes"),
        F.regexp_replace(text, r'(?s)"[^"]*("|$)', '"').alias("plain"),
    )
    step = _count(F.col("plain"), "[", "{") - _count(F.col("plain"), "]") - F.col("closes")
    known = known.withColumn("step", step).withColumn("depth", within("step")).drop("closes")
    known = staging.put(known, "strings")
    sums = known.groupBy("file_path", "block").agg(F.sum("step").alias("step"))
    entering = sums.select("file_path", "block", _sum_before("step").alias("entering")).where("entering <> 0")
    deep = known.join(entering, ["file_path", "block"], "left")
    return deep.withColumn("depth", F.col("depth") + F.coalesce("entering", _zero())).drop("entering")


def values(
    fragments: DataFrame, words: tuple[str, ...], staging: Staging
) -> tuple[DataFrame, DataFrame]:
    """``(values, refused)`` of documents.

    Values: ``file_path, line_number, value, in_array``, one for a document that is one object, or
    one per object of an array, numbered from 1 with its null elements. Refused:
    ``file_path, is_array, has_words, head`` for files that are neither.
    """
    first, between = F.col("no") == 1, (F.col("depth") == 1) & F.col("outside") & (F.col("no") > 1)
    plain = F.col("plain")
    opens = F.when(first, plain.rlike(_FIRST)).otherwise(plain.rlike(_NEXT))
    ends = F.when(first, plain.rlike(_ONLY_NULLS)).otherwise(plain.rlike(_END)) & ~F.col("closed")
    early = (F.col("no") > 1) & F.col("outside") & (F.col("depth") < 1)
    tail = F.when(early, ~F.col("closed") & plain.rlike(f"^{_WHITE}$")).otherwise(True)
    words_in = F.col("value").contains("\\u")
    for word in words:
        words_in = words_in | F.col("value").contains(word)
    commas = _count(F.regexp_extract(plain, r"^[^{]*", 0), ",")
    started = F.when(first & opens, commas + 1).when(between & opens, commas)
    here = Window.partitionBy("file_path", "block").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = _structure(fragments, staging).select(
        *FRAGMENT,
        "block",
        "quotes",
        "step",
        F.when(first, plain.rlike(rf"^{_WHITE}\[")).alias("is_array"),
        F.when(first, plain.rlike(rf"^{_WHITE}\{{")).alias("is_object"),
        F.when(first | between, opens | ends).otherwise(True).alias("separated"),
        ((first | between) & ends).alias("ends"),
        tail.alias("tail"),
        early.alias("early"),
        words_in.alias("words"),
        started.alias("started"),
    )
    rows = staging.put(rows.withColumn("index", F.coalesce(F.sum("started").over(here), _zero())), "structure")

    blocks = rows.groupBy("file_path", "block").agg(
        F.max("is_array").alias("is_array"),
        F.max("is_object").alias("is_object"),
        F.bool_and("separated").alias("separated"),
        F.bool_and("tail").alias("whole"),
        F.bool_or("early").alias("goes_on"),
        F.bool_or("words").alias("has_words"),
        F.sum("step").alias("step"),
        F.sum("quotes").alias("quotes"),
        F.sum("started").alias("started"),
    )
    blocks = staging.put(blocks.withColumn("index_before", _sum_before("started")), "blocks")
    files = blocks.groupBy("file_path").agg(
        *[F.max(name).alias(name) for name in ("is_array", "is_object")],
        *[F.bool_and(name).alias(name) for name in ("separated", "whole")],
        *[F.bool_or(name).alias(name) for name in ("goes_on", "has_words")],
        ((F.sum("step") == 0) & (F.sum("quotes") % 2 == 0)).alias("done"),
    )
    array = F.col("is_array") & F.col("separated") & F.col("done") & ~F.col("goes_on")
    files = staging.put(
        files.select(
            "file_path", "is_array", "has_words", array.alias("array"),
            (F.col("is_object") & F.col("whole") & F.col("done")).alias("object"),
        ),
        "files",
    )

    good = files.where("array OR object").select("file_path", F.col("array").alias("in_array"))
    entering = blocks.select("file_path", "block", "index_before").join(good, "file_path")
    known = rows.join(entering, ["file_path", "block"]).where("NOT (in_array AND ends)")
    opening = F.col("in_array") & F.col("started").isNotNull()
    brace = F.when(F.col("in_array") | F.col("closed"), F.lit("}")).otherwise("")
    both = known.select(
        "file_path",
        F.when(F.col("in_array"), F.col("index_before") + F.col("index")).otherwise(1).alias("line_number"),
        "in_array",
        "no",
        F.concat(F.when(opening, F.regexp_replace("value", r"^[^{]*", "")).otherwise(F.col("value")), brace).alias("text"),
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda p: p["text"])
    joined = both.groupBy("file_path", "line_number", "in_array").agg(F.concat_ws("", parts).alias("value"))
    # the text of the first fragment; a file that is refused may have no path
    heads = rows.where("no = 1").groupBy("file_path").agg(F.min(F.substr("value", F.lit(1), F.lit(200))).alias("head"))
    heads = heads.withColumnRenamed("file_path", "of")
    bad = files.where(~F.col("array") & ~F.col("object"))
    refused = bad.join(heads, F.col("file_path").eqNullSafe(F.col("of")), "left")
    refused = refused.select("file_path", "is_array", "has_words", "head")
    return joined.select("file_path", "line_number", "value", "in_array"), refused

"""Reading dynamic JSON lines into a struct of the fields a source uses.

A shape names containers and leaves. Containers become structs (NULL where the JSON has
something else); leaves stay VARIANT, because what a value may be differs by field:

* ``number``: any JSON number, truncated; strings are refused;
* ``lenient``: the same, and strings holding a plain integer;
* ``strict``: JSON integers only.

A cast alone would turn booleans into integers and any scalar into text, so the kind of a
leaf is tested first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.functions.clock import epoch_to_millis, rfc3339_to_millis
from meterbook.functions.text import none_if_empty, trimmed

Shape = dict

#: Lines above this many bytes are read field by field; the parser for whole values has limits.
LONG_LINE = 8_000_000
NOT_JSON = "not_a_json_object"
_CORRUPT = "_corrupt"


def leaves(*names: str) -> Shape:
    return dict.fromkeys(names, "variant")


def ddl(shape: Shape | str) -> str:
    if isinstance(shape, str):
        return shape
    return "struct<" + ",".join(f"`{k}`:{ddl(v)}" for k, v in shape.items()) + ">"


def read(lines: DataFrame, shape: Shape) -> DataFrame:
    """Add ``doc``: the JSON object of a whole line in the given shape, else NULL.

    The parser stops after the first value and ignores what follows. Parsed as the only
    element of an array, trailing text is an error or a second element, unless it closes
    the bracket itself; lines where that is possible are parsed inside an object as well.
    """
    line, array = F.col("value"), F.col("_array")
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), line, F.lit("}")))
    whole = (
        line.rlike(r"^\s*\{")
        & line.rlike(r"\}\s*$")
        & F.try_variant_get(array, "$[1]", "variant").isNull()
        & F.when(line.rlike(r"\}\s*\]"), in_object.isNotNull()).otherwise(True)
    )
    is_long = F.octet_length(line) > LONG_LINE
    short_text = F.when(~is_long, F.concat(F.lit("["), line, F.lit("]")))
    short = F.when(whole, F.try_variant_get(array, "$[0]", ddl(shape)))
    return (
        lines.withColumn("_array", F.try_parse_json(short_text))
        .withColumn("doc", F.when(is_long, long_document(line, shape)).otherwise(short))
        .drop("_array")
    )


def long_document(line: Column, shape: Shape) -> Column:
    """A long line in the given shape, by the rule of ``read``.

    Only the fields of the shape are kept while the line is read, each as a value of its own, so
    other fields may have any length.
    """
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "maxNestingDepth": "10000"}
    element = "struct<" + ",".join(f"`{name}`:variant" for name in shape) + ">"
    array = F.from_json(F.concat(F.lit("["), line, F.lit("]")), f"array<{element}>", strict)
    checked = f"struct<v:struct<`{_CORRUPT}0`:string>,`{_CORRUPT}`:string>"
    in_object = F.from_json(
        F.concat(F.lit('{"v":'), line, F.lit("}")), checked, {**strict, "columnNameOfCorruptRecord": _CORRUPT}
    )
    whole = (
        line.rlike(r"^\s*\{")
        & line.rlike(r"\}\s*$")
        & (F.size(array) == 1)
        & F.when(line.rlike(r"\}\s*\]"), in_object[_CORRUPT].isNull()).otherwise(True)
    )
    found = F.get(array, F.lit(0))
    fields = [
        found[name] if kind_of == "variant" else F.try_variant_get(found[name], "$", ddl(kind_of))
        for name, kind_of in shape.items()
    ]
    return F.when(whole & found.isNotNull(), F.struct(*[f.alias(n) for f, n in zip(fields, shape)]))


def refusal(doc: Column) -> Column:
    """Why a line with usage words gave nothing, or NULL."""
    return F.when(doc.isNull(), F.lit(NOT_JSON))


def may_contain(line: Column, *words: str) -> Column:
    """Cheap test before parsing: names are in the text unless it uses unicode escapes."""
    found = line.contains("\\u")
    for word in words:
        found = found | line.contains(word)
    return found


def kind(leaf: Column) -> Column:
    """Schema text of a leaf; ``VOID`` is JSON null, NULL is an absent value."""
    return F.schema_of_variant(leaf)


def text(leaf: Column) -> Column:
    """A string that is not empty; anything else is NULL."""
    return none_if_empty(F.when(kind(leaf) == "STRING", leaf.try_cast("string")))


def _first(alternatives: tuple[Column, ...], convert) -> Column:
    """First alternative that ``convert`` accepts.

    Many alternatives go through one array expression: written out one by one, the fields
    of a log line would fill the plan with hundreds of nearly equal expressions.
    """
    if len(alternatives) == 1:
        return convert(alternatives[0])
    found = F.filter(F.transform(F.array(*alternatives), convert), lambda v: v.isNotNull())
    return F.get(found, F.lit(0))


def filled_text(*alternatives: Column) -> Column:
    """First string that is not blank, as it stands."""

    def one(leaf: Column) -> Column:
        value = leaf.try_cast("string")
        return F.when((kind(leaf) == "STRING") & value.rlike(r"(?U)\S"), value)

    return _first(alternatives, one)


def flag(leaf: Column) -> Column:
    return F.coalesce(F.when(kind(leaf) == "BOOLEAN", leaf.try_cast("boolean")), F.lit(False))


def long(*alternatives: Column, mode: str = "lenient") -> Column:
    """First leaf usable as an integer, else NULL."""

    def one(leaf: Column) -> Column:
        number = F.try_variant_get(leaf, "$", "bigint")
        if mode == "strict":
            return F.when(kind(leaf) == "BIGINT", number)
        if mode == "number":
            return F.when(~kind(leaf).isin("BOOLEAN", "STRING"), number)
        return F.when(kind(leaf) != "BOOLEAN", number)

    return _first(alternatives, one)


def count(leaf: Column) -> Column:
    return F.coalesce(long(leaf, mode="number"), F.lit(0).cast("bigint"))


def instant(*alternatives: Column) -> Column:
    """First time in milliseconds, given as RFC 3339 text or as a number, else NULL."""

    def one(leaf: Column) -> Column:
        found = F.coalesce(rfc3339_to_millis(text(leaf)), epoch_to_millis(long(leaf, mode="number")))
        return F.when(found > 0, found)

    return _first(alternatives, one)

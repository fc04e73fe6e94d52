"""Text and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Characters with the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trimmed(c: Column) -> Column:
    """Trim all Unicode white space, not only spaces."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    return F.coalesce(trimmed(c) == "", F.lit(True))


def none_if_blank(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def first_filled(*cols: Column) -> Column:
    """First value that is not blank, as it stands."""
    return F.coalesce(*[none_if_blank(c) for c in cols])


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def same_folded(a: Column, b: Column) -> Column:
    return F.lower(or_empty(a)) == F.lower(or_empty(b))


def project_label(path: Column) -> Column:
    """Last component of a POSIX or Windows path; blank and root paths are ``no-project``."""
    unified = F.regexp_replace(F.translate(trimmed(path), "\\", "/"), "/+$", "")
    base = F.element_at(F.split(unified, "/"), -1)
    return (
        F.when(F.coalesce(unified, F.lit("")) == "", F.lit("no-project"))
        .when(base.isin("", "."), unified)
        .otherwise(base)
    )


def path_parts(path: Column) -> Column:
    """Path components; arrays of them sort the way a directory walk visits files."""
    return F.split(path, "/")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]*$", "")


def tail_from_marker(path: Column, *markers: str, include_marker: bool = True) -> Column:
    """Path below the first of the marker directories, or NULL if none has a child."""
    parts = path_parts(path)
    hits = F.filter(
        F.transform(parts, lambda p, i: F.when(p.isin(*markers) & (i + 1 < F.size(parts)), i + 1)),
        lambda i: i.isNotNull(),
    )
    start = F.get(hits, F.lit(0))
    if not include_marker:
        start = start + 1
    return F.when(start.isNotNull(), F.array_join(F.slice(parts, start, F.size(parts)), "/"))


def cleaned_path(path: Column) -> Column:
    """Lexical clean-up of ``.``, ``..`` and doubled slashes in a relative path."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        last = F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(".."))
        return (
            F.when(part.isin("", "."), acc)
            .when((part == "..") & (last != ".."), F.slice(acc, 1, F.size(acc) - 1))
            .otherwise(F.concat(acc, F.array(part)))
        )

    return F.aggregate(F.split(path, "/"), empty, step, lambda acc: F.array_join(acc, "/"))


def record_subkey(line_number: Column, *subkeys: Column) -> Column:
    """``line:N`` followed by the filled subkeys, joined with ``|``."""
    head = F.concat(F.lit("line:"), line_number.cast("string"))
    return F.concat_ws("|", head, *[none_if_empty(trimmed(s)) for s in subkeys])

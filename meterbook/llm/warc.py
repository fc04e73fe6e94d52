"""WARC derivatives: response records become linked metadata and plain-text conversion records.

Every response gives two records. Both name the response in ``WARC-Refers-To``, carry its target
URI, date and payload digest on, and have record ids derived from the response's id, so a rerun
writes the same records. Digests are SHA-256 in lowercase hex.

* ``metadata`` (``application/warc-fields``): title, language, link and image counts, characters of
  text, and the ids that tie response and conversion together.
* ``conversion`` (``text/plain``): the visible text. Comments, scripts, styles and other invisible
  elements go, block elements break lines, other tags go, character references are decoded and
  white space is collapsed.

Everything is a projection of built-in expressions over one row at a time; nothing shuffles.

Defined cases: a null payload is an empty one and still gives both records; a null target URI or
date leaves its header out; a null key counts as empty text in derived ids; rows that repeat give
records that repeat; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
CAPTURED = "2024-01-01T00:00:00Z"

# Elements that hold no visible text, elements that break lines, named references.
INVISIBLE = ("script", "style", "noscript", "template")
#: Comments and invisible elements, whichever begins first.
HIDDEN = "|".join([r"<!--.*?-->", *[rf"<{name}\b.*?</{name}\s*>" for name in INVISIBLE]])
BLOCKS = (
    "address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html body li main nav ol p pre section table td th title tr ul"
).split()
REFERENCES = (
    ("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("copy", "©"), ("reg", "®"),
    ("middot", "·"), ("hellip", "…"), ("mdash", "—"), ("ndash", "–"), ("laquo", "«"), ("raquo", "»"),
)


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def _uuid(name: Column) -> Column:
    """A version-8 UUID whose other bits are a digest of the name."""
    h = _sha(name)
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3))]
    parts += [F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def responses_of_pages(pages: DataFrame, captured: str = CAPTURED) -> DataFrame:
    """``key, record_id, target_uri, date, payload`` from stored pages."""
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    name = F.concat(F.lit("response "), key, F.lit(" "), F.coalesce("url", F.lit("")))
    return pages.select(
        F.col("page_id").alias("key"),
        _uuid(name).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(captured).alias("date"),
        F.col("html").alias("payload"),
    )


def _numeric_references(text: Column) -> Column:
    """Decode ``&#65;`` and ``&#x41;``; an impossible code point stays as it is written."""

    def point(n: Column) -> Column:
        legal = ((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n < 0x110000))
        return F.when(legal, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def decoded(part: Column) -> Column:
        decimal = F.regexp_extract(part, r"^([0-9]{1,7});", 1)
        hexa = F.regexp_extract(part, r"^[xX]([0-9A-Fa-f]{1,6});", 1)
        number = F.when(decimal != "", decimal.cast("bigint")).otherwise(F.conv(hexa, 16, 10).cast("bigint"))
        ch = point(number)
        rest = F.regexp_replace(part, r"^[^;]*;", "")
        return F.when(ch.isNotNull(), F.concat(ch, rest)).otherwise(F.concat(F.lit("&#"), part))

    parts = F.split(text, "&#")
    tail = F.transform(F.slice(parts, 2, 1 << 30), decoded)
    return F.when(F.contains(text, F.lit("&#")), F.concat(parts[0], F.concat_ws("", tail))).otherwise(text)


def visible_text(html: Column) -> Column:
    text = F.regexp_replace(html, f"(?is){HIDDEN}", "")
    # single blanks, the usual case, are left alone
    text = F.regexp_replace(text, r"[ \t\r\n\f]{2,}|[\t\r\n\f]", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[/!?A-Za-z][^>]*>", "")
    text = _numeric_references(text)
    for name, value in REFERENCES:
        text = F.replace(text, F.lit(f"&{name};"), F.lit(value))
    text = F.replace(text, F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(text, r" *\n[ \n]*", "\n"), F.lit(" \n"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def derivatives(responses: DataFrame) -> DataFrame:
    """One metadata and one conversion record per response.

    ``key, warc_type, record_id, refers_to, target_uri, source_digest, block_digest,
    content_length, headers, block``; a record is its headers, an empty line and its block.
    """
    r = responses.select(
        "key", "record_id", "target_uri", "date", F.coalesce("payload", F.lit("")).alias("payload")
    ).select("*", visible_text(F.col("payload")).alias("text"))
    title = F.regexp_extract("payload", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    language = F.regexp_extract("payload", r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""", 1)
    conversion_id = _uuid(F.concat(F.lit("conversion "), F.col("record_id")))
    fields = F.concat(
        _line("title", F.trim(F.regexp_replace(title, r"\s+", " "))),
        _line("language", language),
        _line("links", F.regexp_count("payload", F.lit(r"(?i)<a\b[^>]*\bhref")).cast("string")),
        _line("images", F.regexp_count("payload", F.lit(r"(?i)<img\b")).cast("string")),
        _line("text-chars", F.length("text").cast("string")),
        _line("conversion", conversion_id),
    )
    metadata_id = _uuid(F.concat(F.lit("metadata "), F.col("record_id")))

    def record(kind: str, mime: str, record_id: Column, block: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("warc_type"), F.lit(mime).alias("mime"), record_id.alias("id"), block.alias("block")
        )

    records = F.array(
        record("metadata", "application/warc-fields", metadata_id, fields),
        record("conversion", "text/plain; charset=utf-8", conversion_id, F.col("text")),
    )
    each = r.select(
        "key",
        "target_uri",
        "date",
        F.col("record_id").alias("refers_to"),
        F.concat(F.lit("sha256:"), _sha(F.col("payload"))).alias("source_digest"),
        F.inline(records),
    )
    digest = F.concat(F.lit("sha256:"), _sha(F.col("block")))
    size = F.octet_length("block").cast("bigint")
    headers = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", F.col("warc_type")),
        _line("WARC-Record-ID", F.col("id")),
        _line("WARC-Refers-To", F.col("refers_to")),
        F.coalesce(_line("WARC-Target-URI", F.col("target_uri")), F.lit("")),
        F.coalesce(_line("WARC-Date", F.col("date")), F.lit("")),
        _line("WARC-Source-Payload-Digest", F.col("source_digest")),
        _line("WARC-Block-Digest", digest),
        _line("Content-Type", F.col("mime")),
        _line("Content-Length", size.cast("string")),
    )
    return each.select(
        "key",
        "warc_type",
        F.col("id").alias("record_id"),
        "refers_to",
        "target_uri",
        "source_digest",
        digest.alias("block_digest"),
        size.alias("content_length"),
        headers.alias("headers"),
        "block",
    )


def record_text(headers: Column, block: Column) -> Column:
    """A record as it is written to a file."""
    return F.concat(headers, F.lit("\r\n"), block, F.lit("\r\n\r\n"))

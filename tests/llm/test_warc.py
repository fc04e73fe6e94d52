import hashlib
import html as H
import re

from meterbook.llm import warc as W

PAGES = [
    "<html lang='fr'><title> A\n b </title><p>x<b>y</b>z<br>q</p><a href='u'>l</a><img src=1></html>",
    "a&nbsp;b &lt;i&gt; &amp;lt; &#65;&#x1F600;&#0;&#55296;&#99999999; &copy; &unknown; &#; &#x;",
    "<script>var t='</p>';</script>a<!-- <p> -->b<STYLE type=x>p{}</STYLE >c < d > e <3",
    "",
    None,
    "  plain \t text \n\n here  ",
    "<div>" * 3000 + "deep" + "</div>" * 3000,
    "word " * 100_000,
    "<title>open",
    "<!-- open <p>x",
    "<script>'<!--'</script>seen<!-- <script> -->too",
]


def visible(page):
    hidden = [rf"<{name}\b.*?</{name}\s*>" for name in ("script", "style", "noscript", "template")]
    text = re.sub("|".join(["<!--.*?-->", *hidden]), "", page or "", flags=re.S | re.I)
    text = re.sub(r"[ \t\r\n\f]+", " ", text)
    text = re.sub(rf"</?({'|'.join(W.BLOCKS)})\b[^>]*>", "\n", text, flags=re.I)
    text = re.sub(r"<[/!?A-Za-z][^>]*>", "", text)

    def point(m):
        n = int(m[2], 16) if m[2] else int(m[1])
        return chr(n) if 0 < n < 0xD800 or 0xDFFF < n < 0x110000 else m[0]

    text = re.sub(r"&#(?:([0-9]{1,7})|[xX]([0-9A-Fa-f]{1,6}));", point, text)
    for name, value in W.REFERENCES:
        text = text.replace(f"&{name};", value)
    return re.sub(r" *\n[ \n]*", "\n", text.replace("&amp;", "&")).strip(" \n")


def test_records_are_linked_and_digests_hold(spark):
    rows = [(i, f"http://h/{i}", p, "x") for i, p in enumerate(PAGES)] + [(None, None, None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, block string")
    responses = {r.key: r for r in W.responses_of_pages(pages).collect()}
    got = W.derivatives(W.responses_of_pages(pages)).collect()
    assert len(got) == 2 * len(rows)
    sha = lambda s: "sha256:" + hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        page = None if r.key is None else PAGES[r.key]
        assert r.refers_to == responses[r.key].record_id and r.source_digest == sha(page or "")
        assert r.block_digest == sha(r.block) and r.content_length == len(r.block.encode())
        head = dict(line.split(": ", 1) for line in r.headers.split("\r\n")[1:-1])
        assert head["WARC-Refers-To"] == r.refers_to and head["WARC-Record-ID"] == r.record_id
        assert head.get("WARC-Target-URI") == r.target_uri and head["WARC-Date"] == W.CAPTURED
        assert head["Content-Length"] == str(r.content_length) and head["WARC-Type"] == r.warc_type
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}>", r.record_id)
        if r.warc_type == "conversion":
            assert r.block == visible(page)
    assert len({r.record_id for r in got}) == 2 * (len(PAGES) + 1)
    conversions = {r.key: r.record_id for r in got if r.warc_type == "conversion"}
    fields = {r.key: dict(x.split(": ", 1) for x in r.block.split("\r\n")[:-1]) for r in got if r.warc_type == "metadata"}
    assert all(fields[k]["conversion"] == c for k, c in conversions.items())
    assert fields[0] == {
        "title": "A b", "language": "fr", "links": "1", "images": "1",
        "text-chars": str(len(visible(PAGES[0]))), "conversion": conversions[0],
    }
    assert visible(PAGES[0]) == "A b\nxyz\nq\nl" and H.unescape("&copy;") == "©"


def test_record_text_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é")], "page_id bigint, url string, html string")
    records = W.derivatives(W.responses_of_pages(pages))
    text = records.where("warc_type = 'conversion'").select(W.record_text(records.headers, records.block)).first()[0]
    assert text.startswith("WARC/1.1\r\n") and text.endswith("\r\n\r\né\r\n\r\n")
    assert W.derivatives(W.responses_of_pages(pages.limit(0))).collect() == []

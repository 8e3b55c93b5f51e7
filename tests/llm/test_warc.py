"""op2: records, links, text, and files."""

import gzip
import hashlib
import random
import re
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_entry import plain
from tidemark.llm import warc
from tidemark.llm.oracles import ORACLES
from tidemark.llm.queries import QUERIES

KIND = "record_id string, target_uri string, date string, http_headers string, payload string"
HTML = '<html lang="en"><head><title>A &amp;\n B</title><style>x</style></head><body><script>var t="</p>";</script><!-- gone --><h1>One</h1><p>Two <b>bold</b> &lt;3 &amp;lt;<br>Three<a href="/x">link</a></p></body></html>'


def derived(spark, rows, kind=KIND):
    return {(r["refers_to"], r["warc_type"]): r for r in warc.derive(spark.createDataFrame(rows, kind)).collect()}


def test_records(spark):
    found = derived(spark, [("urn:uuid:1", "http://a/", "2024-05-05T00:00:00Z", "HTTP/1.1 200 OK\r\nServer: s\r\n\r\n", HTML)])
    text, meta = found["urn:uuid:1", "conversion"], found["urn:uuid:1", "metadata"]
    assert text["block"] == "One\nTwo bold <3 &lt;\nThreelink"
    assert (text["concurrent_to"], meta["concurrent_to"]) == (meta["record_id"], text["record_id"])
    assert text["block_digest"] == "sha256:" + hashlib.sha256(text["block"].encode()).hexdigest()
    assert text["source_payload_digest"] == "sha256:" + hashlib.sha256(HTML.encode()).hexdigest()
    assert text["source_headers"].endswith("Server: s\r\n\r\n") and text["warc_date"] == "2024-05-05T00:00:00Z"
    lines = meta["block"].split("\r\n")
    assert "title: A & B" in lines and "language: en" in lines and "outlink: /x" in lines and f"conversion-record-id: {text['record_id']}" in lines
    assert meta["content_length"] == len(meta["block"].encode())


def test_odd_responses(spark):
    rows = [(None, None, None, None, None), ("r", "u", None, None, ""), ("r", "u", None, None, ""), ("s", "u", "d", "h", "é" * 100_000), ("t", "u", "d", "h", "a < b > c <unclosed")]
    frame = spark.createDataFrame([(*r, "clash", "given") for r in rows], KIND + ", block string, payload_digest string")
    out = warc.derive(frame).collect()
    assert len(out) == 10 and {r["source_payload_digest"] for r in out} == {"given"}
    by = {(r["refers_to"], r["warc_type"]): r for r in out}
    assert by["s", "conversion"]["content_length"] == 200_000 and by["r", "conversion"]["block"] == ""
    assert by["t", "conversion"]["block"] == "a < b > c <unclosed"
    assert derived(spark, []) == {}


def test_file(spark, tmp_path):
    records = warc.derive(spark.createDataFrame([("urn:uuid:1", "http://a/\r\nX: y", "2024-05-05T00:00:00Z", "HTTP/1.1 200 OK\r\nServer: s\r\n\r\n", HTML)], KIND).coalesce(1))
    warc.write_warc(records, str(tmp_path / "w"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path / "w").glob("*.gz"))
    seen = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        assert head.startswith(b"WARC/1.1") and rest[n : n + 4] == b"\r\n\r\n"
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(rest[:n]).hexdigest() and fields["WARC-Refers-To"] == "<urn:uuid:1>"
        assert fields["WARC-Target-URI"] == "http://a/X: y" and "X" not in fields
        if fields["WARC-Type"] == "metadata":
            assert rest[:n].decode().split("\r\n")[-3:] == ["source-header: HTTP/1.1 200 OK", "source-header: Server: s", ""]
        seen.append(fields["WARC-Type"])
        data = rest[n + 4 :]
    assert sorted(seen) == ["conversion", "metadata"]


def test_character_references_and_links(spark):
    html = "<p>&#65;&#x42;&#X43; &#38;lt; &#38;amp; &amp;#65; &#0; &#xD800; &#9999999; &#x1F600; &unknown; &#39;</p><a href='one\n'>x</a><A class=c HREF = two>y</A><a href=\"three\">z</a>"
    found = derived(spark, [("r", "u", "d", "h", html), ("s", "u", "d", "h", "a<script>b</script>c<!-- d" + "<script" * 100_000)])
    assert found["r", "conversion"]["block"] == "ABC &lt; &amp; &#65; \ufffd \ufffd \ufffd \U0001f600 &unknown; '\nxyz"
    assert [x for x in found["r", "metadata"]["block"].split("\r\n") if x.startswith("outlink")] == ["outlink: one", "outlink: two", "outlink: three"]
    assert found["s", "conversion"]["block"] == "a\nc"


def test_query_and_sql_agree_on_odd_pages(spark, tmp_path):
    pages = [(1, "http://a/", "<html lang='x'><p>&#65;&#x42; &#38;lt; &#0;&#xd800;<a href='q&amp;'>&amp;#65;</a><!-- open"), (2, "http://b/", None), (3, "http://c/", ""), (4, "http://d/", "<a href=x\n>&lt;&#60;</a><script>never closed"), (5, "http://e/", "<html lang=\"e\nn\"><title>T &#233;</title>é")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert plain(QUERIES["op2_warc"](spark, str(tmp_path)).toPandas()) == plain(db.execute(ORACLES["op2_warc"]).fetchdf())


HOSTILE = {
    "a": "<a ", "title": "<title>", "title open": "<title ", "head": "<head>", "html": "<html ", "p": "<p ", "comment": "<!-- ", "question": "<?", "link": "<a href", "link quote": "<a href='", "end": "</head ", "references": "",
}


@pytest.mark.parametrize("kind", sorted(HOSTILE))
def test_time_is_linear(spark, kind):
    """A megabyte of openings without ends, also behind and before one that has an end."""
    unit = HOSTILE[kind]
    page = unit * (1_000_000 // len(unit)) if unit else "".join(f"&#{i};" for i in range(200, 120_000))
    rows = [("r", "u", "d", "h", page), ("s", "u", "d", "h", "<html lang='x'><head>a</head><title>b</title><p>" + page), ("t", "u", "d", "h", page + "</head><title>b</title><a href=x>c</a>d")]
    began = time.perf_counter()
    found = derived(spark, rows)
    assert len(found) == 6 and time.perf_counter() - began < 30


def test_sql_agrees_on_openings_without_ends(spark, tmp_path):
    bits = ["<a ", "<a href=x ", "<title ", "<title>", "t</title", "<head>", "</head >", "<HEAD", "<html ", 'lang="e>n" ', 'lang="d"', ">", "<!--", "-->", "<script>", "</script >", "<p ", "x ", "</p", "<?", "&#65;", "\ufffe", "\uffff", "<style", "'", '"']
    draw = random.Random(6)
    pages = [(i, f"http://{i}/", "".join(draw.choice(bits) for _ in range(draw.randint(1, 25)))) for i in range(1500)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert plain(QUERIES["op2_warc"](spark, str(tmp_path)).toPandas()) == plain(db.execute(ORACLES["op2_warc"]).fetchdf())


def test_title_and_language_cost_no_pass_over_the_page(spark):
    """They are looked for up to where they are, in less than one search through all of it takes."""
    page = F.concat(F.lit('<html lang="d"><head><title>T</title></head><p>'), F.repeat(F.lit("Ein Wort, "), 300_000))
    pages = spark.range(8).select(page.alias("html")).persist()
    assert pages.count() == 8

    def seconds(column):
        took = []
        for _ in range(4):
            began = time.perf_counter()
            assert len(pages.select(column.alias("x")).collect()) == 8
            took.append(time.perf_counter() - began)
        return min(took)

    try:
        found = F.concat(warc.title_of(F.col("html")), warc.language_of(F.col("html")))
        assert pages.select(found).first()[0] == "Td" and seconds(found) < seconds(F.col("html").rlike("Q.z"))
    finally:
        pages.unpersist()


def test_blanks_and_names(spark):
    texts = ["", " ", "a", " a ", "a\tb", "a \t\f b", "a  b", "a \n b", "\n\n a \r\n\r\n b \n", "a\n\nb", "a\r", "\fa\n", "&lt;&amp;lt;&nbsp;&nbsp;&gt;&quot;&apos;&copy;&middot;&l&lt;t;"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for text, row in zip(texts, frame.select(warc.tidy(F.col("t")).alias("tidy"), warc.named(F.col("t")).alias("named")).collect(), strict=True):
        assert row["tidy"] == re.sub(" ?\n[ \n]*", "\n", re.sub("[ \t\r\f]+", " ", text)).strip(" \n")
        for name, char in warc.ENTITIES.items():
            text = text.replace(name, char)
        assert row["named"] == text

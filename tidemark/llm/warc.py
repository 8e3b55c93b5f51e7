"""WARC derivative builder: each response record gives a metadata and a plain-text conversion record.

Both refer to the response by its record id (WARC-Refers-To), name each other, keep the source's URI, date and digests, and carry
digests of their own. The source's header block is a column of both and, line by line, part of the metadata record's block, so
that it is in written files as well. Record ids are name-based (an MD5 of source id and kind, written as a UUID), so a
rerun gives the same records and a lost executor changes nothing. All work is one projection over the responses: no shuffle.

Defined results: a null payload counts as empty (its text is empty); a null record id is made from the URI and the payload's
digest; a null URI or date leaves that header out; repeated responses give repeated records; line breaks in a URI or an outlink are
dropped, as browsers do, so that no value can end a header; a comment, script or style without an end runs to the end of the page;
a character reference to no character is U+FFFD; other columns are ignored, except those named in ``keep``, which are carried along.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"

# The named character references that are decoded. Then come those by number, "&amp;" last so that nothing is decoded twice.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&copy;": "\u00a9", "&middot;": "\u00b7"}
NUMBERED = "(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});"
# Elements without text of their own, and elements that begin a new line.
UNSEEN = r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z)|MARKhead\b.*?</head\s*>)"
BLOCK = r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|article|section|header|footer|nav|aside|main|blockquote|pre|form)\b[^>]*+>"
TAG = r"<(?:/?[a-zA-Z]|[!?])[^>]*+>"
# The first <title ..> is the only one that counts: what it lacks, those behind it lack too, so that all the rest is passed over.
TITLE = r"(?is)<title\b(?:[^>]*+>(.*?)</title|.*)"
# Runs of blanks that aren't one space already, and what each of them holds.
BLANKS = r"[ \t\r\f](?:[ \t\r\f]+|(?<=[\t\r\f]))"
BLANK = ("  ", "\t", "\r", "\f")
# An <a> or <html> without what is looked for is passed over up to its end, so that nothing in it is looked at again.
LINK = r"""(?i)<a\b(?:[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|[^>]*+)"""
LANGUAGE = r'(?i)\A<html\b[^>]*\blang="([^"]*)"'
MAYBE_LANGUAGE = r'(?i)<html\b(?:[^>]*\blang="([^"]*)"|[^>]*+)'
#: Characters that no text should have, to mark openings with.
MARKS = ("\ufffe", "\uffff")
#: Up to so many <head> a page is searched as it is: each of them without an end is a search to the end of the page.
FEW_HEADS = 4


def without_unseen(html: Column) -> Column:
    """Comments, scripts, styles and heads go. Only a <head> before the last </head> has an end; where there are many, those are marked, the others are no openings."""
    closed = F.regexp_extract(html, r"(?is)\A.*</head\s*>", 0)
    rest = F.substring(html, F.length(closed) + 1, F.length(html))
    plain = out = F.regexp_replace(html, UNSEEN.replace("MARK", ""), "\n")
    for mark in MARKS:
        marked = F.concat(F.regexp_replace(closed, r"(?i)<(?=head\b)", f"<{mark}"), rest)
        out = F.when(~F.contains(html, F.lit(mark)), F.regexp_replace(marked, UNSEEN.replace("MARK", mark), "\n")).otherwise(out)
    return F.when(F.regexp_count(html, F.lit(r"(?i)<head\b")) <= FEW_HEADS, plain).otherwise(out)


def without_blocks(text: Column) -> Column:
    """A line break for each block's beginning and end."""
    return _in_closed(text, BLOCK, "\n")


def without_tags(text: Column) -> Column:
    """Text without elements, once blocks are lines. Time is linear in the page, here as above: a search for an end only begins where there is one."""
    return _in_closed(text, TAG, "")


def _in_closed(text: Column, pattern: str, by: str) -> Column:
    """``pattern``, whose matches end with ``>``, replaced in what comes before the last one."""
    rest = F.substring_index(text, ">", -1)
    closed = F.substring(text, F.lit(1), F.length(text) - F.length(rest))
    return F.when(F.contains(rest, F.lit("<")), F.concat(F.regexp_replace(closed, pattern, by), rest)).otherwise(F.regexp_replace(text, pattern, by))


def title_of(html: Column) -> Column:
    """What stands between the first <title ..> and </title, if both are there in this order."""
    return F.regexp_extract(html, TITLE, 1)


def language_of(html: Column) -> Column:
    """The first <html ..> with a language gives it."""
    found = F.filter(F.regexp_extract_all(html, F.lit(MAYBE_LANGUAGE), F.lit(0)), lambda x: x.rlike(LANGUAGE))
    first = F.regexp_extract(html, MAYBE_LANGUAGE, 1)
    # Mostly the first <html ..> of all has one, and no other is looked for.
    return F.when(first != "", first).otherwise(F.coalesce(F.regexp_extract(F.try_element_at(found, F.lit(1)), LANGUAGE, 1), F.lit("")))


def links_of(html: Column) -> Column:
    return F.filter(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), lambda x: x != "")


def tidy(text: Column) -> Column:
    """Runs of blanks as one, no empty lines."""
    some = reduce(or_, [F.contains(text, F.lit(x)) for x in BLANK])
    text = F.when(some, F.regexp_replace(text, BLANKS, " ")).otherwise(text)
    return F.trim(F.regexp_replace(F.replace(text, F.lit(" \n"), F.lit("\n")), r"\n[ \n]+", "\n"), F.lit(" \n"))


def _by_number(reference: Column) -> Column:
    """The character of a numeric reference; an ampersand stays a reference, for the last step."""
    digits = F.regexp_extract(reference, NUMBERED, 1)
    code = F.when(F.lower(digits).startswith("x"), F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits).cast("int")
    good = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(code == 38, "&amp;").when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")


def named(text: Column) -> Column:
    """Character references by name as the characters, but for "&amp;"; where no ``&`` is, nothing is searched.

    A name that isn't in the text is replaced as the empty string, which changes nothing: to look for it first costs much less.
    """
    out = text
    for name, char in ENTITIES.items():
        out = F.replace(out, F.when(F.contains(text, F.lit(name)), F.lit(name)).otherwise(""), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def numbered(text: Column) -> Column:
    """Character references by number, then "&amp;"."""
    # What stands between the references, and each reference's character behind it.
    between, found = F.split(text, NUMBERED, -1), F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(0))
    joined = F.array_join(F.zip_with(between, found, lambda t, x: F.concat(t, F.when(x.isNotNull(), _by_number(x)).otherwise(""))), "")
    out = F.when(F.contains(text, F.lit("&#")), joined).otherwise(text)
    return F.when(F.contains(text, F.lit("&")), F.replace(out, F.lit("&amp;"), F.lit("&"))).otherwise(text)


def one_line(value: Column) -> Column:
    return F.regexp_replace(value, "[\\t\\r\\n]", "")


def record_id(*parts: Column) -> Column:
    """A UUID URN made from the parts by MD5."""
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", *parts)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses_from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages (page_id, url, html) as response records; the table has no capture time, so one ``date`` is given to all."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        "page_id",
        record_id(F.lit("response"), F.col("page_id").cast("string"), F.col("url")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(
            F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
            F.octet_length(html).cast("string"),
            F.lit(CRLF * 2),
        ).alias("http_headers"),
        html.alias("payload"),
    )


def derive(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Response records (record_id, target_uri, date, http_headers, payload[, payload_digest]) to two records each.

    Columns: ``keep``, record_id, warc_type, refers_to, concurrent_to, target_uri, warc_date, content_type, source_headers,
    source_payload_digest, block_digest, content_length, block.
    """
    given = F.col("payload_digest") if "payload_digest" in responses.columns else F.lit(None).cast("string")
    text_of = F.coalesce(F.col("payload"), F.lit(""))
    source = responses.select(
        *keep,
        "target_uri",
        "date",
        F.coalesce("http_headers", F.lit("")).alias("headers"),
        text_of.alias("html"),
        F.coalesce(given, digest(text_of)).alias("source_digest"),
        "record_id",
    ).withColumn("record_id", F.coalesce("record_id", record_id(F.lit("response"), F.coalesce("target_uri", F.lit("")), F.col("source_digest"))))
    # Step by step, so that no expression stands in another twice and is worked out again.
    parts = {"_text": without_unseen(F.col("html")), "_title": title_of(F.col("html"))}
    source = source.withColumns(parts).withColumn("_text", without_blocks(F.col("_text"))).withColumn("_text", without_tags(F.col("_text")))
    source = source.withColumns({c: named(F.col(c)) for c in parts}).withColumns({c: numbered(F.col(c)) for c in parts})
    source = source.withColumns(
        {
            "text": tidy(F.col("_text")),
            "metadata_id": record_id(F.lit("metadata"), F.col("record_id")),
            "conversion_id": record_id(F.lit("conversion"), F.col("record_id")),
            "title": F.trim(F.regexp_replace("_title", "[ \\t\\r\\n\\f]+", " ")),
            "language": one_line(language_of(F.col("html"))),
            "links": F.transform(links_of(F.col("html")), lambda x: one_line(F.regexp_replace(x, "^[\"']|[\"']$", ""))),
        }
    )
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    metadata = F.concat(
        field("source-record-id", F.col("record_id")),
        field("source-payload-digest", F.col("source_digest")),
        field("source-content-length", F.octet_length("html").cast("string")),
        field("conversion-record-id", F.col("conversion_id")),
        field("conversion-block-digest", digest(F.col("text"))),
        field("title", F.col("title")),
        field("language", F.col("language")),
        F.array_join(F.transform("links", lambda x: field("outlink", x)), ""),
        F.array_join(F.transform(F.filter(F.split("headers", "\r?\n"), lambda x: x != ""), lambda x: field("source-header", F.replace(x, F.lit("\r"), F.lit("")))), ""),
    )
    made = lambda kind, own, other, mime, block: F.struct(
        own.alias("record_id"), F.lit(kind).alias("warc_type"), other.alias("concurrent_to"), F.lit(mime).alias("content_type"), block.alias("block")
    )
    return source.select(
        *keep,
        F.explode(
            F.array(
                made("metadata", F.col("metadata_id"), F.col("conversion_id"), "application/warc-fields", metadata),
                made("conversion", F.col("conversion_id"), F.col("metadata_id"), "text/plain; charset=utf-8", F.col("text")),
            )
        ).alias("r"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        F.col("date").alias("warc_date"),
        F.col("headers").alias("source_headers"),
        F.col("source_digest").alias("source_payload_digest"),
    ).select(
        *keep,
        "r.record_id",
        "r.warc_type",
        "refers_to",
        "r.concurrent_to",
        "target_uri",
        "warc_date",
        "r.content_type",
        "source_headers",
        "source_payload_digest",
        digest(F.col("r.block")).alias("block_digest"),
        F.octet_length("r.block").cast("long").alias("content_length"),
        "r.block",
    )


def serialised(records: DataFrame) -> DataFrame:
    """Records as WARC/1.1 text in column ``value``, without the two line ends that close a record."""
    header = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    angle = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    return records.select(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}"),
            header("WARC-Type", F.col("warc_type")),
            header("WARC-Record-ID", angle("record_id")),
            header("WARC-Refers-To", angle("refers_to")),
            header("WARC-Concurrent-To", angle("concurrent_to")),
            header("WARC-Target-URI", one_line(F.col("target_uri"))),
            header("WARC-Date", one_line(F.col("warc_date"))),
            header("WARC-Block-Digest", F.col("block_digest")),
            header("WARC-Source-Payload-Digest", F.col("source_payload_digest")),
            header("Content-Type", F.col("content_type")),
            header("Content-Length", F.col("content_length").cast("string")),
            F.lit(CRLF),
            F.col("block"),
        ).alias("value")
    )


def write_warc(records: DataFrame, path: str) -> None:
    """One gzip-compressed WARC file for each partition."""
    serialised(records).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)

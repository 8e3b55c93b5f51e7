"""Fill-in-the-middle: texts cut after whole units at two chosen places, their parts put in another order between markers.

Units are matched left to right; a document's cut requests are two numbers of units. Matches are rows: posexplode gives each unit's
number and length, a running sum over a document the code points up to it, a join with the requests by document and number the places
of the cuts, and an aggregate both places of a document; substrings do the rest. Only documents that are cut are taken apart, and
only up to their second cut. What is shuffled for it is their units' lengths (once for rows of one id and text, summed up before the
shuffle) and, for the last join, their texts; other documents stay where they are. Units are rows after the shuffle only, and
the running sum, the join and the aggregate need none of their own. A document's units are sorted with spilling.

The numbers behind the choices are the first 8-digit groups of the hex SHA-256 of ``seed:id``, so they don't depend on order or
partitions.

Defined results: a null text is empty; empty texts, and texts that hold a marker, are plain (output as they are); a null id is an empty
one; repeated rows are each there, with equal results; an empty table stays empty; other columns are kept, but for those
that are named as a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")
_KEYS = ["id", "a", "b"]


def unit_lengths(text: Column) -> Column:
    """The code points of each unit, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), F.length)


def draw(key: Column, i: int) -> Column:
    """The i-th (from 1) 8-digit group of a hex digest as an unsigned number."""
    return F.conv(F.substring(key, 8 * i - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """``docs`` with n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output.

    ``percent`` of the documents are cut, and ``spm_percent`` of those put the suffix first.
    """
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    own = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), ident), 256)
    rows = docs.select(F.struct(*docs.columns).alias("row"), own.alias("own"), ident.alias("id"), digest.alias("digest"))
    marked = F.col("own").contains(PREFIX) | F.col("own").contains(SUFFIX) | F.col("own").contains(MIDDLE)
    plain = (F.col("own") == "") | marked | (draw(F.col("digest"), 3) % 100 >= percent)
    rows = rows.withColumn("form", F.when(plain, "plain").when(draw(F.col("digest"), 4) % 100 < spm_percent, "spm").otherwise("psm"))
    # Rows of one id and text are cut in the same places. Two hashes with seeds of their own stand for the text.
    cut = rows.where("form <> 'plain'").withColumns({k: F.xxhash64(F.lit(k), "own") for k in ("a", "b")})
    found = cut.join(_places(cut), _KEYS, "left").select("row", "own", "form", "n", "lo", "hi")
    whole = rows.where("form = 'plain'").select("row", "own", "form", F.size(F.regexp_extract_all("own", F.lit(UNIT), F.lit(0))).alias("n"), *[F.lit(None).cast("int").alias(c) for c in ("lo", "hi")])
    both = found.unionByName(whole)
    return both.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in RESULTS],
        F.col("n").cast("long").alias("n"),
        "form",
        F.col("lo").cast("long").alias("prefix_chars"),
        (F.col("hi") - F.col("lo")).cast("long").alias("middle_chars"),
        arranged(F.col("own"), F.col("form"), F.col("lo"), F.col("hi")).alias("output"),
    )


def _places(cut: DataFrame) -> DataFrame:
    """(id, a, b, n, lo, hi): the number of units and the code points before the first and the second cut."""
    sized = cut.select(*_KEYS, "digest", unit_lengths(F.col("own")).alias("lengths")).withColumn("n", F.size("lengths"))
    requests = [draw(F.col("digest"), i) % (F.col("n") + 1) for i in (1, 2)]
    sized = sized.withColumns({"first": F.least(*requests).cast("int"), "second": F.greatest(*requests).cast("int")})
    # Ahead of the units a unit without length, so that a cut after no unit has its place too.
    needed = F.concat(F.array(F.lit(0)), F.slice("lengths", F.lit(1), F.col("second")))
    once = sized.groupBy(*_KEYS).agg(F.first(F.struct("n", "first", "second", needed.alias("lengths"))).alias("u"))
    running = F.sum("length").over(Window.partitionBy(*_KEYS).orderBy("unit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    units = once.select(*_KEYS, F.posexplode("u.lengths").alias("unit", "length")).select(*_KEYS, "unit", running.alias("chars"))
    asked = once.select(*_KEYS, "u.n", F.explode(F.array(F.struct(F.lit("lo").alias("cut"), F.col("u.first").alias("ordinal")), F.struct(F.lit("hi").alias("cut"), F.col("u.second").alias("ordinal")))).alias("r"))
    # The ordinals are compared by their difference: as a key of the join they would have all units shuffled anew.
    on = [F.col(f"units.{k}") == F.col(f"asked.{k}") for k in _KEYS]
    # Both sides lie by document already, so a merge moves nothing; a broadcast would move the units.
    met = units.alias("units").hint("merge").join(asked.alias("asked"), [*on, (F.col("unit") - F.col("r.ordinal")) == 0]).select(*[f"asked.{k}" for k in _KEYS], "n", "r.cut", "chars")
    at = lambda which: F.max(F.when(F.col("cut") == which, F.col("chars"))).cast("int").alias(which)
    return met.groupBy(*_KEYS).agg(F.max("n").alias("n"), at("lo"), at("hi"))


def arranged(text: Column, form: Column, lo: Column, hi: Column) -> Column:
    """The output for a text whose prefix has ``lo`` code points and whose middle ends at ``hi``."""
    prefix, middle, suffix = F.substring(text, F.lit(1), lo), F.substring(text, lo + 1, hi - lo), F.substring(text, hi + 1, F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "plain", text).when(form == "psm", psm).otherwise(spm)


def restored(output: Column, form: Column) -> Column:
    """The text, from the output and the form alone.

    The parts hold no marker, and none can arise where a part meets a marker, as markers begin with a character that they don't have elsewhere.
    """
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))

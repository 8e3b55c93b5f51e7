"""Line dedup by overlapping windows of three lines.

Every three consecutive lines of a document are hashed to 128 bits: each line, trimmed of ASCII white space, is hashed twice with
different beginnings, and a window's two hashes are made from one kind each. A window found at more
than one place keeps its first place, in order of (doc_id, position), and loses the later ones: the positions that later
places cover are merged, and those lines are removed. A later place that overlaps the kept first place in the same document
covers only what lies behind it. Windows of nothing but empty lines do not count.

The first places come from one aggregate with partial aggregation on each map side, so a passage that a third of all
documents share costs a row per task; the join that follows is one that Spark splits by skew. Texts are shuffled once.

Defined results: a null text stays null with 0 lines; texts of fewer than three lines stay as they are; rows with the same
doc_id and text are one document (all of them keep or lose the same lines) and rows with the same doc_id and other text are
told apart by a hash; a null doc_id comes first in order; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 3
BLANKS = " \t\r\x0b\x0c"


def line_windows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each window: doc (key and hash of the text), pos, h1, h2."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)))
    hashed = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b")))
    return (
        docs.where(F.col(text).contains("\n"))
        .select(F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("h")).alias("doc"), lines.alias("lines"))
        .where(F.size("lines") >= SPAN)
        .select("doc", "lines", hashed.alias("hashes"))
        .select(
            "doc",
            F.explode(
                F.filter(
                    F.transform(
                        F.sequence(F.lit(0), F.size("lines") - SPAN),
                        lambda i: F.struct(
                            i.alias("pos"),
                            F.xxhash64(*[F.get("hashes", i + k)["a"] for k in range(SPAN)]).alias("h1"),
                            F.xxhash64(*[F.get("hashes", i + k)["b"] for k in range(SPAN)]).alias("h2"),
                            F.greatest(*[F.length(F.get("lines", i + k)) for k in range(SPAN)]).alias("longest"),
                        ),
                    ),
                    lambda w: w["longest"] > 0,
                )
            ).alias("w"),
        )
        .select("doc", "w.pos", "w.h1", "w.h2")
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``text`` cleaned, and n_lines, n_removed (long)."""
    windows = line_windows(docs, key, text)
    place = F.struct(F.col("doc.id").alias("id"), F.col("doc.h").alias("h"), F.col("pos"))
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("not (first <=> last)").select("h1", "h2", "first")
    same_doc = F.col("doc.id").eqNullSafe(F.col("first.id")) & (F.col("doc.h") == F.col("first.h"))
    covered = (
        windows.join(first, ["h1", "h2"])
        .where(~(same_doc & (F.col("pos") == F.col("first.pos"))))
        .select("doc", F.when(same_doc, F.greatest("pos", F.col("first.pos") + SPAN)).otherwise(F.col("pos")).alias("from"), (F.col("pos") + SPAN - 1).alias("to"))
        .where("from <= to")
        .groupBy("doc")
        .agg(F.collect_set(F.struct("from", "to")).alias("spans"))
        .select(F.col("doc.id").alias("_id"), F.col("doc.h").alias("_h"), F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["from"], s["to"])))).alias("_gone"))
    )
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone")), lambda i: F.get("_lines", i)), "\n")
    names = [F.col(c) for c in docs.columns if c not in (text, "n_lines", "n_removed")]
    joined = docs.join(covered, F.col(key).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_h")), "left")
    return joined.withColumn("_lines", lines).select(
        *names,
        F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept).alias(text),
        F.when(F.col(text).isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )

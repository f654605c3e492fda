"""Line de-duplication by overlapping windows of consecutive lines.

Every run of three consecutive lines is hashed; a run found more than once in
the corpus keeps its first occurrence (smallest document id, then smallest
line number), and every later occurrence is covered.  Covered runs overlap, so
their line numbers are merged before the lines are cut out.

Defined results: a null text has no lines and stays null; a text of fewer than
three lines is left alone; runs of nothing but white space are no evidence and
are left alone; rows that share a document id are one document for the
ordering, so none of them removes the lines of another one, while each removes
its own later repeats; a null id comes before every other id; an empty table
gives an empty table.  Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetpulse.llm.common import DOCUMENT_COLUMNS, table, text_key

WINDOW = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, covered): line numbers to cut, merged and sorted, per document that has any.

    The hash aggregate combines before its shuffle, so a passage in a third of
    all documents costs one row per task; the join back is an equality join
    that adaptive execution can split.  A document's covered lines are bounded
    by the document itself.
    """
    lines = docs.select(F.col(id_col).alias("doc"), text_key(id_col, text_col).alias("key"), lines_of(F.col(text_col)).alias("lines"))

    def run(i: Column) -> Column:
        joined = F.concat_ws("\n", F.slice(F.col("lines"), i + 1, F.lit(window)))
        return F.when(joined.rlike(r"[^\x20\x09-\x0D]"), F.struct(F.xxhash64(joined).alias("h1"), F.xxhash64(F.lit(1), joined).alias("h2")))

    runs = F.transform(F.sequence(F.lit(0), F.size("lines") - F.lit(window)), run)
    found = (
        lines.filter(F.size("lines") >= window)
        .select("doc", "key", F.posexplode(runs).alias("pos", "run"))
        .filter(F.col("run").isNotNull())
        .select("doc", "key", "pos", "run.h1", "run.h2")
    )
    first = (
        found.groupBy("h1", "h2")
        .agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .drop("n")
    )
    later = found.join(first, ["h1", "h2"]).filter(F.struct("doc", "pos") > F.col("first"))
    spread = F.flatten(F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + window - 1)))
    return later.groupBy("key").agg(F.sort_array(F.array_distinct(spread)).alias("covered"))


def cut_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the covered lines cut from the text, and counts of what went.

    Adds ``line_total``, ``line_removed`` and ``line_spans`` (maximal covered runs).
    """
    covered = repeated_lines(docs, id_col, text_col, window)
    # The whole row rides in one struct, so that no column of it can clash with ours.
    whole = docs.select(F.struct("*").alias("row"), text_key(id_col, text_col).alias("key"))
    joined = whole.join(covered, "key", "left").withColumn("lines", lines_of(F.col(f"row.{text_col}")))
    total = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    text = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    spans = F.size(F.filter(F.col("covered"), lambda p, i: (i == 0) | (F.get(F.col("covered"), i - 1) != p - 1)))
    hit = F.col("covered").isNotNull()
    return joined.select(
        *[F.when(hit, text).otherwise(F.col(f"row.{c}")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns],
        total.cast("long").alias("line_total"),
        F.when(hit, F.size("covered")).otherwise(0).cast("long").alias("line_removed"),
        F.when(hit, spans).otherwise(0).cast("long").alias("line_spans"),
    )


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its repeated lines; n_chars follows a text that was cut."""
    cut = cut_lines(docs.select(*DOCUMENT_COLUMNS))
    size = F.when(F.col("line_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", size).select(*DOCUMENT_COLUMNS)


def op10_line_windows(spark, sf_dir: str) -> DataFrame:
    cut = cut_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id",
        F.col("line_total").alias("n_lines"),
        F.col("line_removed").alias("n_removed"),
        F.col("line_spans").alias("n_spans"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, p, lines[p + 1] || chr(10) || lines[p + 2] || chr(10) || lines[p + 3] AS run
  FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS p FROM l)
),
f AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS k
  FROM w WHERE regexp_matches(run, '[^\x20\x09-\x0D]')
),
c AS (SELECT DISTINCT doc_id, p + unnest([0, 1, 2]) AS p FROM f WHERE k > 1),
each AS (SELECT doc_id, unnest(range(0, len(lines))) AS p, unnest(lines) AS line FROM l),
marked AS (SELECT e.*, c.p IS NOT NULL AS gone FROM each e LEFT JOIN c USING (doc_id, p)),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM marked)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM runs GROUP BY doc_id
"""

"""How document filters interact: what each one removes in every order they can be applied in.

Every document gets a mask with one bit for each filter that it fails.  A mask
decides the document's fate in any order, so documents are first counted by
(part, mask): at most 32 cells a part, whatever the number of documents.  A
recursive query then extends prefixes of filters by every unused letter, joins
each prefix with the mask cells and carries the bits applied so far; each level
of the recursion states what that step removes, keeps or finds removed already.
The recursion runs over masks only, 32 x 325 rows at most; the counts of the
parts are joined to it afterwards.

The test for repeated texts compares digests of whole texts (SHA-256), never
the texts.  Repeats are counted per (digest, part, labels) before any group is
formed, so a text that a third of all rows share is a handful of rows.

Defined results: null text is empty; null source is the empty part, together
with the source that is empty; rows that repeat a document count once each, and
rows that share an id are not earlier than each other; a row without an id is
neither earlier nor later than any other, and has no label; several labels of
one id count as good (or toxic) if any says so; an empty table gives no rows.
Columns other than doc_id, text, source of the documents and doc_id, quality,
toxic of the labels are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from fleetpulse.llm.common import UPPER, table, words
from fleetpulse.session import materialize

#: Fixed values of the five filters.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 200, 50, 2, "[#$%&*|]"
REPEATED = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides alone, by letter."""
    text = F.coalesce(text, F.lit(""))
    found = words(text)
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(found) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(found)) < MIN_DISTINCT_PERCENT * F.size(found),
        "C": 100 * upper.cast("long") > MAX_UPPER_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def bit(letter: str, letters: str) -> int:
    return 1 << letters.index(letter)


def mask_cells(docs: DataFrame, labels: DataFrame, filters=text_filters, repeated: str = REPEATED) -> DataFrame:
    """(part, mask, n, good, toxic), counts of documents; bit i of the mask is the i-th letter, the last one the repeats."""
    tests = filters(F.col("text"))
    letters = "".join(tests) + repeated
    alone = sum((F.when(failed, bit(letter, letters)).otherwise(0) for letter, failed in tests.items()), F.lit(0))
    marks = labels.groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"),
    )
    narrow = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), alone.alias("mask"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    )
    # Rows of one id first, spread by (digest, id), so that no later group holds more than one row an id.
    per_id = narrow.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    # Rows without an id match no label and are spread by their text.
    keyed = per_id.withColumn("has_id", F.col("doc_id").isNotNull()).withColumn("key", F.coalesce("doc_id", F.xxhash64("digest")))
    marked = marks.filter("doc_id IS NOT NULL").withColumn("has_id", F.lit(True)).withColumnRenamed("doc_id", "key")
    known = keyed.join(marked, ["key", "has_id"], "left").fillna(0, ["good", "toxic"])
    per_text = known.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("first"),
        F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("at_first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
    )
    least = F.min("first").over(W.partitionBy("digest"))
    unlike = F.col("no_id") + F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(0)
    split = per_text.withColumn("least", least).withColumn("unlike", unlike).select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("mask"), F.col("unlike").alias("n")),
            F.struct((F.col("mask") + bit(repeated, letters)).alias("mask"), (F.col("n") - F.col("unlike")).alias("n")),
        )).alias("cell"),
    )
    return split.filter("cell.n > 0").groupBy("part", F.col("cell.mask").alias("mask")).agg(
        F.sum("cell.n").alias("n"), F.sum(F.col("cell.n") * F.col("good")).alias("good"), F.sum(F.col("cell.n") * F.col("toxic")).alias("toxic")
    )


STEPS = """
WITH RECURSIVE steps AS (
  SELECT CAST('' AS STRING) AS prefix, 0 AS applied, 0 AS bit, 0 AS step, mask FROM {masks}
  UNION ALL
  SELECT concat(prefix, substr(:letters, next + 1, 1)), applied | shiftleft(1, next), shiftleft(1, next), step + 1, cell.mask
  FROM (SELECT *, explode(filter(sequence(0, length(:letters) - 1), i -> applied & shiftleft(1, i) = 0)) AS next
        FROM steps WHERE step < length(:letters)) AS extended
  JOIN {masks} AS cell ON cell.mask = extended.mask
)
SELECT prefix, step, bit, mask,
  mask & applied = 0 AS keeps,
  mask & bit <> 0 AND mask & (applied ^ bit) = 0 AS removes,
  mask & bit <> 0 AND mask & (applied ^ bit) <> 0 AS repeats,
  mask = bit AS only
FROM steps WHERE step > 0
"""


def steps(masks: DataFrame, letters: str) -> DataFrame:
    """Every prefix of filters with every mask: what its last step does to documents with that mask."""
    return masks.sparkSession.sql(STEPS, args={"letters": letters}, masks=masks)


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    cells = materialize(cells, "mask-cells")
    walked = materialize(steps(cells.select("mask").distinct(), letters), "filter-steps")

    def count(of: str, where: str) -> Column:
        return F.sum(F.when(F.col(where), F.col(of)).otherwise(0))

    # At most 2^letters rows for each prefix: a bound that does not depend on the data.
    metrics = cells.join(F.broadcast(walked), "mask").groupBy("part", "prefix", "step").agg(
        count("n", "keeps").alias("kept"), count("n", "removes").alias("removed"), count("n", "repeats").alias("redundant"),
        count("n", "only").alias("unique_fails"), count("good", "removes").alias("good_lost"), count("toxic", "removes").alias("toxic_lost"),
    )
    whole = walked.filter(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    parts = whole.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("at"))
    orders = parts.select("filter_order", F.substring("filter_order", F.lit(1), F.col("at")).alias("prefix"))
    listed = metrics.join(F.broadcast(orders), "prefix")
    same = W.partitionBy("part", F.substring("prefix", -1, 1))
    return listed.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(same).alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(mask_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "ABCDE")


ORACLE = r"""
WITH RECURSIVE orders AS (
  SELECT '' AS filter_order, 0 AS n
  UNION ALL
  SELECT filter_order || l, n + 1 FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS letters(l)
  WHERE n < 5 AND NOT contains(filter_order, l)
), texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), failed AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM texts
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, fails
), judged AS (
  SELECT part, filter_order, s AS step, cells.n AS n, good, toxic, fails,
    filter_order[s:s] AS letter,
    contains(fails, filter_order[s:s]) AS hit,
    fails <> '' AND regexp_matches(fails, '[' || filter_order[1:s-1] || '-]') AS gone
  FROM cells, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s) WHERE orders.n = 5
), summed AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM summed
"""

"""Temperature mixing of sources.

Token shares are raised to an exponent between 0 (all sources alike) and 1
(as they come) and normalised.  The exponent is found by bisection: the
smallest one at which no source is repeated more than ``max_epochs`` times, and
at which the weights' entropy is at most ``entropy`` if one is asked for.  The
token budget is the least at which every source is used whole at least once, so
mixing repeats documents and drops none.

The weights are realised in epochs.  In each epoch the blocks of a source are
permuted, and so are the documents in a block.  The last epoch of a source is
cut where its budget ends: whole blocks first, then documents of the one block
that straddles the budget.  No window runs over a source: blocks carry sums.

Defined results: a null source is a source; a source without tokens is used
once; null and empty texts have no tokens and are taken with the block they are
in; repeated rows are repeated documents; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from fleetpulse.llm.common import DOCUMENT_COLUMNS, WORD, table
from fleetpulse.session import materialize

STEPS = 50


@dataclass(frozen=True)
class Mix:
    """``blocks`` per source bounds the rows any window sorts."""

    max_epochs: float = 4.0
    entropy: float | None = None
    blocks: int = 4096
    seed: int = 17


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_plan(totals: DataFrame, mix: Mix) -> DataFrame:
    """(source, tokens, exponent, weight, budget) from (source, tokens).

    One row per source goes in, so the bisection is an expression over the
    array of totals; texts and documents are no part of it.
    """
    target = "1e300D" if mix.entropy is None else f"{mix.entropy!r}D"
    code = f"""
      transform(array(filter(transform(all, s -> cast(s.tokens AS double)), t -> t > 0)), ts ->
        aggregate(sequence(1, {STEPS}), struct(0D AS lo, 1D AS hi), (s, i) ->
          transform(array((s.lo + s.hi) / 2), a ->
            transform(array(aggregate(ts, 0D, (x, t) -> x + power(t / array_max(ts), a))), z ->
              CASE WHEN power(array_min(ts) / array_max(ts), a - 1) <= {mix.max_epochs!r}D
                AND aggregate(ts, 0D, (x, t) -> x - power(t / array_max(ts), a) / z * ln(power(t / array_max(ts), a) / z)) <= {target}
              THEN struct(s.lo AS lo, a AS hi) ELSE struct(a AS lo, s.hi AS hi) END)[0])[0],
          s -> CASE WHEN size(ts) = 0 THEN 1D ELSE s.hi END))[0]
    """
    listed = totals.agg(F.collect_list(F.struct("source", "tokens")).alias("all"))
    solved = listed.select("all", F.expr(code).alias("exponent"), F.expr("cast(array_max(transform(all, s -> s.tokens)) AS double)").alias("most"))
    each = solved.select(F.explode("all").alias("s"), "exponent", "most").select("s.source", "s.tokens", "exponent", "most")
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("most"), F.col("exponent"))).otherwise(0.0)
    scale = F.sum("power").over(W.partitionBy())
    return (
        each.withColumn("power", power)
        .withColumn("weight", F.when(scale > 0, F.col("power") / scale).otherwise(0.0))
        .withColumn("budget", F.floor(F.greatest(F.col("most") * F.col("power"), F.col("tokens").cast("double"))).cast("long"))
        .drop("power", "most")
    )


def order_key(mix: Mix, *parts: Column) -> Column:
    """A permutation key that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(mix.seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def block_of(mix: Mix, doc: Column) -> Column:
    return F.conv(F.substring(order_key(mix, F.lit("block"), doc), 1, 7), 16, 10).cast("long") % mix.blocks


def mix_sources(
    docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None, text_col: str = "text"
) -> DataFrame:
    """Rows of ``docs`` once per epoch they are drawn in, under ``row``, with epoch, block, weight and order keys.

    Sort by (epoch, block_key, doc_key) within a source for its permuted order.
    """
    count = token_count(F.col(text_col)) if tokens is None else tokens
    keyed = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), F.col(id_col).alias("doc"), count.alias("tokens"))
    keyed = keyed.withColumn("block", block_of(mix, F.col("doc")))
    sums = materialize(keyed.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    plan = source_plan(sums.groupBy("source").agg(F.sum("tokens").alias("tokens")), mix)
    # Few rows, one per source; written so that the join below knows its size.
    plan = materialize(
        plan.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("long"))
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("whole") * F.col("tokens")).otherwise(0))
        .select(F.col("source").alias("of"), "exponent", "weight", "budget", "whole", "rest"),
        "mix-plan",
    )
    same = F.col("source").eqNullSafe(F.col("of"))
    in_last = W.partitionBy("source").orderBy("block_key", "block")
    blocks = (
        sums.join(plan, same)
        .withColumn("block_key", order_key(mix, F.col("source"), F.col("block"), F.col("whole")))
        .withColumn("upto", F.sum("tokens").over(in_last))
    )
    # Blocks fit in the order of their keys, so one key a source says which do; no document is shuffled to learn it.
    fits, straddles = F.col("upto") <= F.col("rest"), (F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("tokens") < F.col("rest"))
    last = blocks.groupBy(F.col("source").alias("in_source")).agg(
        F.max(F.when(fits, F.col("block_key"))).alias("fit_key"), F.max(F.when(straddles, F.col("block"))).alias("edge"),
        F.max(F.when(straddles, F.col("upto") - F.col("tokens"))).alias("before"),
    )
    last = materialize(last, "mix-last")
    drawn = keyed.join(plan, same).drop("of")
    full = drawn.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    tail = drawn.join(last, F.col("source").eqNullSafe(F.col("in_source"))).withColumn("epoch", F.col("whole"))
    tail = tail.withColumn("fits", order_key(mix, F.col("source"), F.col("block"), F.col("whole")) <= F.col("fit_key"))
    tail = tail.withColumn("straddles", F.col("block") == F.col("edge"))
    cut = W.partitionBy("source", "block").orderBy("doc_key", F.xxhash64("doc", "tokens"))
    tail = tail.withColumn("doc_key", order_key(mix, F.col("doc"), F.col("epoch")))
    names = ["row", "source", "doc", "tokens", "block", "epoch", "weight", "exponent", "budget"]
    inside = tail.filter("fits").select(*names)
    edge = tail.filter("straddles").withColumn("here", F.col("before") + F.sum("tokens").over(cut)).filter(F.col("here") <= F.col("rest")).select(*names)
    return (
        full.select(*names).unionByName(inside).unionByName(edge)
        .withColumn("block_key", order_key(mix, F.col("source"), F.col("block"), F.col("epoch")))
        .withColumn("doc_key", order_key(mix, F.col("doc"), F.col("epoch")))
    )


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once per epoch they are drawn in, in their permuted order.

    The order keys are hashes, so ranges of them cut every source and block
    alike; an epoch is over before the next begins.
    """
    order = ["epoch", "block_key", "doc_key"]
    drawn = mix_sources(docs.select(*DOCUMENT_COLUMNS)).select("row", *order)
    return drawn.repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"))
    # Only counts are needed here; they are taken once, from whole texts.
    counted = materialize(docs, "mix-docs")
    mixed = mix_sources(counted, tokens=F.col("n_tokens"))
    return mixed.select(
        F.col("doc").alias("doc_id"), "source", "tokens", "epoch", "block", "block_key", "doc_key", F.round("weight", 6).alias("weight"), F.round("exponent", 6).alias("exponent"), "budget"
    )


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens,
    ('0x' || substr(md5('17|block|' || doc_id), 1, 7))::BIGINT % 4096 AS block FROM documents
),
t AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY source),
b(i, lo, hi) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT i + 1,
    CASE WHEN pow((SELECT min(tokens) / max(tokens)::DOUBLE FROM t), (lo + hi) / 2 - 1) <= 4 THEN lo ELSE (lo + hi) / 2 END,
    CASE WHEN pow((SELECT min(tokens) / max(tokens)::DOUBLE FROM t), (lo + hi) / 2 - 1) <= 4 THEN (lo + hi) / 2 ELSE hi END
  FROM b WHERE i < 50
),
x AS (SELECT hi AS exponent FROM b WHERE i = 50),
w AS (
  SELECT source, tokens, exponent, pow(tokens / (max(tokens) OVER ())::DOUBLE, exponent) AS p,
    greatest(max(tokens) OVER () * pow(tokens / (max(tokens) OVER ())::DOUBLE, exponent), tokens) AS want FROM t, x
),
p AS (
  SELECT source, exponent, p / sum(p) OVER () AS weight, floor(want)::BIGINT AS budget,
    floor(want)::BIGINT // tokens AS whole, floor(want)::BIGINT % tokens AS rest FROM w
),
k AS (
  SELECT source, doc_id, d.tokens, block, exponent, weight, budget, whole, rest,
    md5('17|' || source || '|' || block || '|' || whole) AS bk, md5('17|' || doc_id || '|' || whole) AS dk
  FROM d JOIN p USING (source)
),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY bk, block, dk) AS upto FROM k),
e AS (
  SELECT *, unnest(range(0, whole)) AS epoch FROM s
  UNION ALL
  SELECT *, whole FROM s WHERE upto <= rest
)
SELECT doc_id, source, tokens, epoch, block, md5('17|' || source || '|' || block || '|' || epoch) AS block_key,
  md5('17|' || doc_id || '|' || epoch) AS doc_key, round(weight, 6) AS weight, round(exponent, 6) AS exponent, budget FROM e
"""

"""Quality rules with cutoffs that carry a guarantee.

Six counts of a text are always taken; two of them fail a document outright.
The other rules compare a rate with a cutoff that is chosen per stratum
(language) on labelled documents.  All cutoffs of all rates stand in one fixed
order, from loose to strict, and step j puts the first j of them in force, so
that what a step rejects the later ones reject too.  The steps of a stratum are
tested in this order: an exact binomial test must show that all rates together
reject at most ``limit`` of its good documents.  The first step that fails ends
the sequence and the one before it decides, which needs no further correction
over steps; the level is shared out over the strata by their labelled
documents, which corrects over strata.  A stratum whose first step fails, as
one with few labels does, keeps its documents.

Defined results: a null text has no words and fails; labels that are neither 0
nor 1 or whose document is missing are not used; a document is good if a label
row says so, and counts once however many rows of labels or documents repeat
it, as its strictest row; null languages are a stratum of their own; an empty
table gives an empty table; input columns named like a count or a verdict are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fleetpulse.llm.common import DOCUMENT_COLUMNS, SPACE, table, words
from fleetpulse.session import materialize

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
POSITION_BITS = 20


@dataclass(frozen=True)
class Risk:
    """``limit``: share of good documents that the rates together may reject; ``level``: chance that this fails."""

    limit: float = 0.02
    level: float = 0.05


#: Rate and the cutoffs tried for it; a document is rejected above the cutoff.
CUTOFFS: dict[str, tuple[float, ...]] = {
    "symbol_rate": (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5),
    "repeat_rate": (0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45),
    "dup_lines_per_word": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5),
    "mean_word_length": (7.0, 7.5, 8.0, 8.5, 9.0, 10.0, 12.0, 15.0, 20.0),
}


def steps() -> list[tuple[str, float]]:
    """Cutoffs from loose to strict: the rates take turns by the share of their own cutoffs that lies behind them."""
    places = [((i + 1) / len(values), n, r, c) for n, (r, values) in enumerate(CUTOFFS.items()) for i, c in enumerate(sorted(values, reverse=True))]
    return [(r, c) for _, _, r, c in sorted(places)]


def rates() -> dict[str, Column]:
    per_word = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_rate": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / per_word,
        "dup_lines_per_word": F.col("n_dup_lines") / per_word,
        "mean_word_length": F.col("word_chars") / per_word,
    }


def rejecting_step() -> Column:
    """Number from 1 of the first step that rejects the row; one past the last if none does."""
    firsts = []
    for rate, value in rates().items():
        first = F.lit(len(steps()) + 1)
        for j, (r, c) in reversed(list(enumerate(steps(), 1))):
            first = F.when(value > c, j).otherwise(first) if r == rate else first
        firsts.append(first)
    return F.least(*firsts)


def repeated_word_count(w: str) -> Column:
    """Words covered by three-word windows that the text holds twice or more.

    The hash of a window and its place share one long, so one primitive sort
    brings equal windows together.  Neighbours are then compared by their
    words; should two different windows share the hash bits, or a text have
    more words than places, the windows themselves are sorted.
    """
    mask = (1 << POSITION_BITS) - 1
    code = f"""
      aggregate(
        transform(array({w}), ws ->
          transform(array(sort_array(transform(sequence(0, size(ws) - 3), i ->
              (xxhash64(ws[i], ws[i + 1], ws[i + 2]) & {~mask}L) | i))), codes ->
            transform(array(filter(codes, (c, j) ->
                (j > 0 AND (get(codes, j - 1) & {~mask}L) = (c & {~mask}L))
                OR ((get(codes, j + 1) & {~mask}L) <=> (c & {~mask}L)))), twins ->
              CASE WHEN size(ws) > {mask} OR exists(sequence(0, size(twins)), j -> j > 0
                   AND (get(twins, j) & {~mask}L) = (get(twins, j - 1) & {~mask}L)
                   AND (ws[cast(get(twins, j) & {mask}L as int)] <> ws[cast(get(twins, j - 1) & {mask}L as int)]
                     OR ws[cast(get(twins, j) & {mask}L as int) + 1] <> ws[cast(get(twins, j - 1) & {mask}L as int) + 1]
                     OR ws[cast(get(twins, j) & {mask}L as int) + 2] <> ws[cast(get(twins, j - 1) & {mask}L as int) + 2]))
              THEN transform(array(sort_array(transform(sequence(0, size(ws) - 3), i ->
                     struct(ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c, i AS i)))), whole ->
                   sort_array(transform(filter(whole, (x, j) ->
                     (j > 0 AND get(whole, j - 1).a = x.a AND get(whole, j - 1).b = x.b AND get(whole, j - 1).c = x.c)
                     OR (get(whole, j + 1).a <=> x.a AND get(whole, j + 1).b <=> x.b AND get(whole, j + 1).c <=> x.c)),
                     x -> x.i)))[0]
              ELSE sort_array(transform(twins, c -> cast(c & {mask}L as int))) END)[0])[0])[0],
        struct(-3 AS last, 0 AS total),
        (acc, p) -> struct(p AS last, acc.total + least(3, p - acc.last) AS total),
        acc -> cast(acc.total AS long))
    """
    return F.when(F.size(w) >= 4, F.expr(code)).otherwise(F.lit(0).cast("long"))


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts of STATS and ``base_failed``; all inside the JVM, one row at a time, no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    with_words = docs.withColumn("_words", words(F.col(text_col)))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = (
        with_words.withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", repeated_word_count("_words"))
        .drop("_words", "_lines")
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def binomial_tail(n: str, k: str, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed term by term from X = 0; 1 from the mean on."""
    ratio = f"ln({p}D / (1 - {p}D))"
    code = f"""
      CASE WHEN {k} >= {n} * {p}D THEN 1D ELSE
      aggregate(sequence(0L, {k}), struct({n} * ln(1 - {p}D) AS term, 0D AS total),
        (acc, i) -> struct(
          acc.term + ln(greatest({n} - i, 1L) / cast(i + 1 AS double)) + {ratio} AS term,
          acc.total + exp(acc.term) AS total),
        acc -> acc.total) END
    """
    return F.expr(code)


def choose_steps(stats: DataFrame, labels: DataFrame, risk: Risk = Risk(), stratum: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """(stratum, n, step): labelled good documents that pass the base rules, and the last step that is admitted (0: none).

    ``stats`` is the table of counts.  Each good document is one number, the
    step that rejects it first, so the aggregate has one row per stratum and
    task.  A later step never rejects fewer, so the last step below the level
    is also the end of the sequence.
    """
    good = labels.filter(F.col("quality") == 1).select(F.col(id_col).alias("_id")).distinct()
    holdout = stats.filter(~F.col("base_failed")).select(F.col(id_col).alias("_id"), F.col(stratum).alias("stratum"), rejecting_step().alias("_first"))
    once = holdout.join(good, "_id").groupBy("_id", "stratum").agg(F.min("_first").alias("_first"))
    rejected = [F.sum((F.col("_first") <= j).cast("long")).alias(f"t{j}") for j in range(1, len(steps()) + 1)]
    counted = materialize(once.groupBy("stratum").agg(F.count("*").alias("n"), *rejected), "cutoffs")
    tries = F.array(*[F.struct(F.lit(j).alias("step"), F.col(f"t{j}").alias("k")) for j in range(1, len(steps()) + 1)])
    flat = counted.select("stratum", "n", F.explode(tries).alias("t")).select("stratum", "n", "t.*")
    share = F.col("n") / counted.agg(F.sum("n")).scalar()
    passed = binomial_tail("n", "k", risk.limit) <= risk.level * share
    return flat.groupBy("stratum", "n").agg(F.max(F.when(passed, F.col("step")).otherwise(0)).alias("step"))


def cutoffs_of(chosen: DataFrame) -> DataFrame:
    """(stratum, rate, cutoff): the cutoffs in force at the admitted steps, for reports."""
    listed = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(r).alias("rate"), F.lit(c).alias("cutoff")) for j, (r, c) in enumerate(steps(), 1)])
    return chosen.select("stratum", "step", F.explode(listed).alias("c")).filter("c.j <= step").groupBy("stratum", "c.rate").agg(F.min("c.cutoff").alias("cutoff"))


def judge(stats: DataFrame, chosen: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add ``kept``.  One row per stratum is joined; Spark checks their size before it broadcasts."""
    admitted = materialize(chosen.select(F.col("stratum").alias("_stratum"), F.col("step").alias("_step")), "cutoffs")
    joined = stats.join(admitted, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    rejected = rejecting_step() <= F.coalesce(F.col("_step"), F.lit(0))
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_stratum", "_step")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    Counts are written beside the documents once, since the cutoffs need all of
    them before the first verdict; no text is shuffled.
    """
    counted = materialize(with_stats(docs.select(*DOCUMENT_COLUMNS)), "quality")
    chosen = choose_steps(counted.select("doc_id", "lang", *STATS, "base_failed"), table(spark, sf_dir, "labels"))
    return judge(counted, chosen).filter("kept").select(*DOCUMENT_COLUMNS)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    stats = materialize(with_stats(docs).drop("text"), "quality")
    chosen = choose_steps(stats, table(spark, sf_dir, "labels"))
    return judge(stats, chosen).select("doc_id", *STATS, "base_failed", "kept")


def oracle_sql(risk: Risk = Risk()) -> str:
    """The query in DuckDB's SQL, with windows as rows and the binomial tail through lgamma."""
    rate = {
        "symbol_rate": "n_symbols / greatest(word_chars, 1)::DOUBLE",
        "repeat_rate": "n_repeat_words / greatest(n_words, 1)::DOUBLE",
        "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1)::DOUBLE",
        "mean_word_length": "word_chars / greatest(n_words, 1)::DOUBLE",
    }
    tries = ", ".join(f"({j}, '{r}', {c}::DOUBLE)" for j, (r, c) in enumerate(steps(), 1))
    values = " ".join(f"WHEN '{r}' THEN {e}" for r, e in rate.items())
    limit = risk.limit
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM d)),
twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, run) AS n FROM w),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, p + unnest([0, 1, 2]) AS q FROM twice WHERE n > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
st AS (
  SELECT doc_id, lang, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)
),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM st),
c(step, rate, cutoff) AS (VALUES {tries}),
h AS (SELECT DISTINCT f.* FROM f JOIN labels USING (doc_id) WHERE quality = 1 AND NOT base_failed),
over AS (SELECT lang, doc_id, step FROM h, c WHERE (CASE rate {values} END) > cutoff),
k AS (
  SELECT g.lang, g.n, s.step, (SELECT count(DISTINCT doc_id) FROM over WHERE over.lang IS NOT DISTINCT FROM g.lang AND over.step <= s.step) AS k
  FROM (SELECT lang, count(DISTINCT doc_id) AS n FROM h GROUP BY lang) g, c s
),
p AS (
  SELECT lang, n, step, CASE WHEN k >= n * {limit} THEN 1 ELSE list_sum(list_transform(range(0, k + 1),
    lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({limit}) + (n - i) * ln(1 - {limit})))) END AS p FROM k
),
failed AS (SELECT lang, min(step) AS step FROM p WHERE p > {risk.level} * n / (SELECT count(DISTINCT (lang, doc_id)) FROM h) GROUP BY lang),
a AS (SELECT g.lang, coalesce(failed.step - 1, {len(steps())}) AS step FROM (SELECT DISTINCT lang FROM h) g LEFT JOIN failed ON failed.lang IS NOT DISTINCT FROM g.lang),
bad AS (SELECT DISTINCT f.doc_id FROM f JOIN a ON a.lang IS NOT DISTINCT FROM f.lang JOIN c ON c.step <= a.step WHERE (CASE c.rate {values} END) > c.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM f
"""

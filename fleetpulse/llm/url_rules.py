"""URL filters: stated rules first, then association rules mined from them.

Stated rules name a host and a path prefix and judge that host with all its
subdomains; the longest one that fits wins.  The pages they judge are the
labelled examples.  FP-growth mines combinations of URL tokens that go with a
label; rules under a confidence or support are pruned, and so is a rule that a
shorter one makes superfluous.  What is left is indexed by the rarest token of
each rule; a page looks its tokens up, checks the few rules found for the rest
of their tokens, and takes the most confident one (ties: block, then the rule
with more support, then its text).  A page that no rule reaches is allowed.

Defined results: a null URL, or one without ``://``, has empty host and path,
meets no stated rule, has no token and is allowed; repeated and null page ids
are judged row by row, since decisions belong to URLs; with no labelled page
nothing is mined; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from fleetpulse.llm.common import ascii_lower, table
from fleetpulse.session import materialize


@dataclass(frozen=True)
class Stated:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


STATED = (
    Stated("org", "/", "allow"),
    Stated("example.org", "/es/", "block"),
    Stated("example.org", "/en/1", "block"),
    Stated("com", "/fr/", "allow"),
    Stated("com", "/de/", "block"),
)


@dataclass(frozen=True)
class Mining:
    """``max_tokens`` bounds the items of one transaction tree, not of a URL's match."""

    min_support: float = 0.005
    min_confidence: float = 0.8


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host lower-cased in A-Z."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def stated_rule(host: Column, path: Column, rules: tuple[Stated, ...] = STATED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest stated rule that fits, else nulls.

    The rules are a parameter written by hand, so they become one expression.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.text).otherwise(name)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host by depth, words of the path, names of query fields, scheme.

    Digits are folded, so that page numbers are not tokens of their own.
    """
    labels = F.transform(F.reverse(F.split(host, r"\.")), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    parts = F.transform(F.split(ascii_lower(path), r"[/._\-]+"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    fields = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^([^=]*)", 1)))
    scheme = F.array(F.concat(F.lit("s:"), F.regexp_extract(F.coalesce(url, F.lit("")), "^([A-Za-z]+)://", 1)))
    named = F.filter(F.concat(labels, parts, fields, scheme), lambda t: F.length(t) > F.instr(t, ":"))
    return F.when(host != "", F.array_distinct(named)).otherwise(F.array().cast("array<string>"))


def with_rules(pages: DataFrame, url_col: str = "url", rules: tuple[Stated, ...] = STATED) -> DataFrame:
    host, path = split_url(F.col(url_col))
    parsed = pages.withColumn("host", host).withColumn("path", path)
    name, verdict = stated_rule(F.col("host"), F.col("path"), rules)
    return parsed.withColumn("rule", name).withColumn("stated", verdict)


def mine(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(tokens, verdict, confidence, support) from rows (tokens, verdict).

    FP-growth shards its trees over the cluster; what reaches the driver inside
    it is the list of frequent tokens, of which there are at most
    mean tokens per URL / min_support.
    """
    items = labelled.select(F.concat(F.col("tokens"), F.array(F.concat(F.lit("verdict:"), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=mining.min_support, minConfidence=mining.min_confidence).fit(items)
    told = model.associationRules.filter(F.col("consequent")[0].startswith("verdict:"))
    told = told.filter(~F.exists("antecedent", lambda t: t.startswith("verdict:")))
    return told.select(
        F.sort_array("antecedent").alias("tokens"),
        F.substring(F.col("consequent")[0], 9, 100).alias("verdict"),
        "confidence",
        "support",
    )


def prune(rules: DataFrame) -> DataFrame:
    """Drop a rule if leaving out one of its tokens gives a rule of the same verdict that is as confident.

    The shorter rule fires wherever the longer one does.  The subsets are
    looked up by equality.
    """
    shorter = rules.filter(F.size("tokens") > 1).select(
        "tokens", "verdict", "confidence", F.explode(F.transform("tokens", lambda t: F.array_remove(F.col("tokens"), t))).alias("fewer")
    )
    known = rules.select(F.col("tokens").alias("fewer"), "verdict", F.col("confidence").alias("known"))
    needless = shorter.join(known, ["fewer", "verdict"]).filter(F.col("known") >= F.col("confidence")).select("tokens", "verdict")
    return rules.join(needless, ["tokens", "verdict"], "left_anti")


def index_rules(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """Add ``post``: the token of each rule that fewest labelled pages have."""
    rate = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    of_rules = rules.select("*", F.explode("tokens").alias("token")).join(rate, "token")
    return of_rules.groupBy("tokens", "verdict", "confidence", "support").agg(F.min(F.struct("n", "token")).alias("rarest")).select(
        "tokens", "verdict", "confidence", "support", F.col("rarest.token").alias("post")
    )


def filter_urls(pages: DataFrame, url_col: str = "url", rules: tuple[Stated, ...] = STATED, mining: Mining = Mining()) -> DataFrame:
    """``pages`` with host, path, rule (stated or null), verdict and the mined rule that decided.

    A URL is matched once however many pages have it.
    """
    judged = with_rules(pages, url_col, rules)
    urls = judged.select(F.col(url_col).alias("_url"), "host", "path", "stated").filter(F.col("host") != "")
    tokens = urls.withColumn("tokens", url_tokens(F.col("_url"), F.col("host"), F.col("path")))
    labelled = tokens.filter(F.col("stated").isNotNull()).select("tokens", F.col("stated").alias("verdict"))
    # Written once: mining reads it twice, and the rules get a known size for the join.
    labelled = materialize(labelled, "url-labels")
    mined = materialize(index_rules(materialize(prune(mine(labelled, mining)), "url-rules"), labelled), "url-index")
    open_urls = tokens.filter(F.col("stated").isNull()).select("_url", "tokens").dropDuplicates(["_url"])
    hits = (
        open_urls.withColumn("post", F.explode("tokens"))
        .join(mined.withColumnRenamed("tokens", "needed"), "post")
        .filter(F.size(F.array_except("needed", "tokens")) == 0)
    )
    best = hits.groupBy("_url").agg(
        F.max(F.struct("confidence", (F.col("verdict") == "block").alias("blocks"), "support", F.array_join("needed", " ").alias("mined"))).alias("best")
    )
    chosen = best.select("_url", F.when(F.col("best.blocks"), "block").otherwise("allow").alias("_told"), F.col("best.mined").alias("mined"))
    out = judged.join(chosen, F.col(url_col) == F.col("_url"), "left")
    return out.withColumn("verdict", F.coalesce("stated", "_told", F.lit("allow"))).drop("_url", "_told", "stated")


def op9_url_rules(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "mined")


def oracle_sql(rules: tuple[Stated, ...] = STATED, mining: Mining = Mining()) -> str:
    """The query in DuckDB's SQL; every subset of every labelled URL's tokens is counted."""
    longest = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    fits = {r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in longest}
    name = " ".join(f"WHEN {e} THEN '{r.text}'" for r, e in fits.items())
    verdict = " ".join(f"WHEN {e} THEN '{r.verdict}'" for r, e in fits.items())
    return rf"""
WITH a AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
b AS (SELECT page_id, coalesce(url, '') AS url, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {name} END AS rule, CASE {verdict} END AS stated FROM b),
t AS (
  SELECT *, CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct(list_filter(
    list_transform(list_reverse(string_split(host, '.')), lambda x, i: 'h' || (i - 1) || ':' || x) ||
    list_transform(regexp_split_to_array(lower(path), '[/._\-]+'), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '0', 'g')) ||
    list_transform(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: 'q:' || regexp_extract(x, '^([^=]*)', 1)) ||
    ['s:' || regexp_extract(url, '^([A-Za-z]+)://', 1)], lambda y: length(y) > instr(y, ':')))) END AS tokens FROM c
),
l AS (SELECT tokens, stated FROM t WHERE stated IS NOT NULL),
sub AS (SELECT stated, list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) AS need FROM (SELECT *, unnest(range(1, 1::BIGINT << len(tokens))) AS m FROM l)),
n AS (SELECT need, stated, count(*) AS hits, sum(count(*)) OVER (PARTITION BY need) AS n FROM sub GROUP BY need, stated),
r AS (
  SELECT need, stated, hits / n::DOUBLE AS confidence, hits / (SELECT count(*) FROM l)::DOUBLE AS support FROM n
  WHERE hits >= ceil({mining.min_support} * (SELECT count(*) FROM l)) AND hits / n::DOUBLE >= {mining.min_confidence}
),
sh AS (SELECT r.*, unnest(list_transform(need, lambda x: list_filter(need, lambda y: y <> x))) AS fewer FROM r WHERE len(need) > 1),
bad AS (SELECT DISTINCT sh.need, sh.stated FROM sh JOIN r ON r.need = sh.fewer AND r.stated = sh.stated WHERE r.confidence >= sh.confidence),
g AS (SELECT r.* FROM r ANTI JOIN bad USING (need, stated)),
o AS (SELECT DISTINCT url, tokens FROM t WHERE stated IS NULL),
hit AS (SELECT o.url, g.*, row_number() OVER (PARTITION BY o.url ORDER BY confidence DESC, (g.stated = 'block') DESC, support DESC, array_to_string(need, ' ') DESC) AS k
  FROM o JOIN g ON list_has_all(o.tokens, g.need)),
best AS (SELECT * FROM hit WHERE k = 1)
SELECT page_id, host, path, rule, coalesce(t.stated, best.stated, 'allow') AS verdict,
  CASE WHEN t.stated IS NULL THEN array_to_string(best.need, ' ') END AS mined
FROM t LEFT JOIN best ON best.url = t.url AND t.stated IS NULL
"""

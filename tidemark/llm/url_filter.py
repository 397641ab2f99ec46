"""URL filters by association rules over URL tokens.

Base rules come first: each has a host and a path prefix and covers the host, its subdomains and paths that start with the
prefix; the longest that fits decides. Where none fits, mined rules do. A url's label is that of the document of its number; it
is bad if the document is of low quality or toxic. A combination of tokens is a rule if it covers ``MIN_ROWS`` labelled urls and
a share ``MIN_CONFIDENCE`` of them is bad, by the lower end of a Wilson interval so that few urls don't convince; a combination
that contains a smaller rule adds nothing and is pruned. Combinations have any number of tokens, and the counts wanted don't
depend on the table's size.

Spark's FP-growth finds the combinations, and three steps keep it from enumerating what can't matter: single tokens are counted
first, and those that are rules by themselves leave the baskets, as all that holds one is pruned; so do tokens in fewer bad urls
than any rule needs; and tokens that stand in exactly the same labelled urls are one item, as whatever holds for one of them
holds for all. (What is left is FP-growth's own cost: it grows with the number of frequent combinations of common tokens.)

Matching is by inverted index: each rule is filed under its rarest item, a url's items are looked up there by an equi-join, and
a rule found so fits if all its items are in the url. Only urls that no base rule decides take part in it.

Defined cases: a null url or one without ``://`` has an empty host and path and no tokens, so it is allowed by default;
repeated rows are judged one by one; without labels there are no mined rules; labels that are null count as good; a page_id
with several labels counts once for each.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, lower_ascii, written

#: (verdict, host, path).
BASE_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Urls a mined rule covers at least, and the least share of them that is bad (lower bound).
MIN_ROWS, MIN_CONFIDENCE = 20, 0.5
#: Equal baskets that one row becomes at a time.
COPIES = 1000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty without ``://``; A-Z of the host lowered."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def base_verdict(host: Column, path: Column, rules=BASE_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest base rule that fits, or nulls. Longest: host and path together, then the host."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: the words of the host, and those of the path that aren't numbers."""
    found = lambda text, kind: F.transform(F.regexp_extract_all(lower_ascii(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.concat(F.lit(f"{kind}="), x))
    return F.array_distinct(F.concat(found(host, "host"), F.filter(found(path, "path"), lambda x: ~x.rlike("^path=[0-9]*$"))))


def lower_bound(n_bad, n, sqrt=math.sqrt):
    """Lower end of the Wilson interval of the share n_bad / n."""
    z, p = 1.64, n_bad / n
    return (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def least_bad(min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> int:
    """The bad urls that any rule has at least: those that convince among ``min_rows``, as more rows need more."""
    return next((b for b in range(1, min_rows) if lower_bound(b, min_rows) >= min_confidence), min_rows)


def mine_rules(labelled: DataFrame, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE, keep=written) -> tuple[DataFrame, DataFrame]:
    """Rules (items, n, n_bad, key) and what the items stand for (token, item), from labelled urls (tokens, bad).

    An item stands for the tokens of the same labelled urls, and for any of them it is there; key is a rule's rarest item.
    ``keep`` writes a table that is read more than once.
    """
    least = least_bad(min_rows, min_confidence)
    good = (F.col("n") >= min_rows) & (lower_bound(F.col("n_bad"), F.col("n"), F.sqrt) >= min_confidence)
    baskets = keep(labelled.groupBy("tokens").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad")))
    filed = baskets.select("tokens", "n", "n_bad", F.explode("tokens").alias("token"))
    # tokens of the same baskets have equal sums of the baskets' hashes (two of them, and the number)
    where = [F.sum(F.xxhash64("tokens", F.lit(i)).cast("decimal(38,0)")).alias(f"h{i}") for i in (1, 2)]
    tokens_ = filed.groupBy("token").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"), F.count("*").alias("in"), *where).filter(F.col("n_bad") >= least)
    tokens_ = keep(tokens_.withColumn("rule", good))
    singles = tokens_.filter("rule").select(F.array("token").alias("items"), "n", "n_bad", F.col("token").alias("key"))
    alone = tokens_.filter("rule").select("token", F.col("token").alias("item"))
    rest = tokens_.filter("NOT rule")
    by = ["n", "n_bad", "in", "h1", "h2"]
    # tokens with equal sums are few, so they meet by an aggregation and not by a window over all
    shared = keep(rest.groupBy(*by).agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens")).select("item", "n", F.explode("tokens").alias("token")))
    bad = filed.filter("n_bad > 0").join(shared.select("token", "item"), "token").groupBy("tokens", "n", "n_bad").agg(F.collect_set("item").alias("items"))
    # a basket for each bad url again; those of a url that comes very often are made by many tasks
    bad = bad.filter(F.size("items") > 1).select("items", "n_bad", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bad") - 1, F.lit(COPIES).cast("long"))).alias("_from")).repartition("items", "_from")
    bad = keep(bad.select("items", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n_bad") - F.col("_from"), F.lit(COPIES).cast("long")))).alias("_i")).drop("_i"))
    rows = bad.count()
    if rows < least:
        return singles, alone
    # a support just below the wanted count, so that rounding up inside never asks for one row more
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / rows, minConfidence=1.0).fit(bad).freqItemsets
    often = shared.groupBy("item").agg(F.first("n").alias("often"))
    sets = found.filter(F.size("items") > 1).select(F.array_sort("items").alias("needs"), F.col("freq").alias("n_bad"))
    keyed = sets.select("*", F.explode("needs").alias("item")).join(often, "item").groupBy("needs", "n_bad").agg(F.min(F.struct("often", "item")).alias("least"))
    keyed = keyed.select("needs", "n_bad", F.col("least.item").alias("key"))
    held = filed.join(shared.select("token", "item"), "token").groupBy("tokens", "n").agg(F.collect_set("item").alias("items"))
    every = held.select("items", "n", F.explode("items").alias("key")).join(keyed, "key").filter(F.size(F.array_except("needs", "items")) == 0)
    rules = keep(every.groupBy(F.col("needs").alias("items"), "n_bad", "key").agg(F.sum("n").alias("n")).filter(good).select("items", "n", "n_bad", "key"))
    # a rule that holds a smaller one, found under the smaller one's key
    smaller = rules.select(F.col("items").alias("needs"), "key")
    implied = rules.select("items", F.explode("items").alias("key")).join(smaller, "key").filter((F.size("needs") < F.size("items")) & (F.size(F.array_except("needs", "items")) == 0)).select("items").distinct()
    return singles.unionByName(rules.join(implied, "items", "left_anti")), alone.unionByName(shared.select("token", "item"))


def match(pages: DataFrame, mined: DataFrame, stands: DataFrame) -> DataFrame:
    """The ``_row`` of pages (_row, tokens) that some rule fits."""
    held = pages.select("_row", F.explode("tokens").alias("token")).join(stands, "token").groupBy("_row").agg(F.collect_set("item").alias("items"))
    filed = held.select("_row", "items", F.explode("items").alias("key"))
    return filed.join(mined.select("key", F.col("items").alias("needs")), "key").filter(F.size(F.array_except("needs", "items")) == 0).select("_row").distinct()


def judge_urls(pages: DataFrame, labels: DataFrame, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url)."""
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = base_verdict(F.col("host"), F.col("path"))
    judged = parts.select("*", rule.alias("rule"), verdict.alias("verdict"))
    # equal urls get equal verdicts, so matches are found once for each host and path
    decided = F.col("verdict").isNotNull() | (F.col("host") == "")
    undecided = judged.filter(~decided)
    distinct = undecided.select("host", "path").distinct().select(F.struct("host", "path").alias("_row"), tokens(F.col("host"), F.col("path")).alias("tokens"))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.select(F.col("doc_id").alias("_id"), bad.alias("bad"))
    with Scratch(pages.sparkSession) as tables:
        labelled = parts.filter("host <> ''").join(known, F.col("page_id") == F.col("_id")).select(tokens(F.col("host"), F.col("path")).alias("tokens"), "bad")
        mined, stands = mine_rules(tables(labelled), min_rows, min_confidence, tables)
        hits = written(match(distinct, mined, stands).select(F.col("_row.host").alias("_host"), F.col("_row.path").alias("_path"), F.lit("block").alias("found")))
    out = undecided.join(hits, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    out = out.select("page_id", "host", "path", "rule", F.coalesce("found", F.lit("allow")).alias("verdict"))
    return out.unionByName(judged.filter(decided).select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict")))


def op3_url_filters(spark, sf_dir):
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return judge_urls(pages, labels)


def url_filters_planted(spark, sf_dir):
    """The same over labels that do depend on the urls: a page is bad if its host says blog and its path en.

    With the confidence asked for here no other combination is a rule, so the verdicts can be told by SQL.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host, path = split_url(F.col("url"))
    words = tokens(host, path)
    bad = F.array_contains(words, "host=blog") & F.array_contains(words, "path=en")
    labels = pages.select(F.col("page_id").alias("doc_id"), F.when(bad, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    return judge_urls(pages, labels, min_confidence=0.9)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PARTS_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                     WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                     WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                     WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                     WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM s)"""
_BASE_SQL = "CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL OR ({}) THEN 'block' ELSE 'allow' END AS verdict"

#: Every subset of every labelled url's tokens is counted: the definition of the rules, without any of the mining.
OP3_SQL = rf"""{_PARTS_SQL},
t AS (SELECT *, list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(host, '[a-z0-9]+'), lambda x: 'host=' || x),
        list_transform(list_filter(regexp_extract_all({_LOWER.format("path")}, '[a-z0-9]+'), lambda x: NOT regexp_matches(x, '^[0-9]*$')), lambda x: 'path=' || x)))) AS w FROM b),
l AS (SELECT w, coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 AS bad FROM t JOIN labels ON page_id = doc_id WHERE host <> ''),
c AS (SELECT list_filter(w, lambda x, i: (m >> (i - 1)) & 1 = 1) AS needs, bad FROM (SELECT w, bad, unnest(range(1, CAST(1 AS BIGINT) << len(w))) AS m FROM l)),
n AS (SELECT needs, count(*)::DOUBLE AS n, (count(*) FILTER (bad))::DOUBLE AS k FROM c GROUP BY needs HAVING count(*) >= {MIN_ROWS}),
g AS (SELECT needs FROM n WHERE (k / n + 1.64 * 1.64 / (2 * n) - 1.64 * sqrt(k / n * (1 - k / n) / n + 1.64 * 1.64 / (4 * n * n))) / (1 + 1.64 * 1.64 / n) >= {MIN_CONFIDENCE})
SELECT page_id, host, path, rule, {_BASE_SQL.format("host <> '' AND EXISTS (SELECT 1 FROM g WHERE list_has_all(w, needs))")} FROM t
"""

PLANTED_SQL = rf"""{_PARTS_SQL},
d AS (SELECT *, regexp_matches(host, '(^|[^a-z0-9])blog([^a-z0-9]|$)') AND regexp_matches({_LOWER.format("path")}, '(^|[^a-z0-9])en([^a-z0-9]|$)') AS bad FROM b),
n AS (SELECT count(*) FILTER (bad)::DOUBLE AS n FROM d),
-- all n rows of the combination are bad, so the lower end of the interval is n / (n + z^2)
m AS (SELECT n >= {MIN_ROWS} AND n / (n + 1.64 * 1.64) >= 0.9 AS mined FROM n)
SELECT page_id, host, path, rule, {_BASE_SQL.format("bad AND mined")} FROM d, m
"""

"""URL filter: explicit host/path rules, then association rules mined from labelled pages.

FP-growth (Spark ML, JVM) mines the combinations of URL tokens that at least ``min_bad`` bad pages
share. A combination becomes a rule where at least ``min_confidence`` of the labelled pages that hold
it are bad. Both bounds look only at pages with these tokens, so a rule, and a page's verdict, stays
as it is when other pages are labelled, at any size of the table. A rule with a smaller rule inside it
is redundant and dropped. Each rule is posted in an inverted index under its rarest token only, so a
URL meets a rule once, and the rest of the rule is checked against the URL's token array.

A page of t tokens holds 2 ** t combinations, which FP-growth would list. Where a bad page has more than ``most_tokens``
tokens that ``min_bad`` bad pages share, all rules are found level by level instead: sets that a smaller rule, or a smaller
set of the same pages, makes redundant are never widened. Both ways find every rule; no token is left out.

Labels are joined by id: ``labels.doc_id`` is taken as the ``page_id`` of the same value.
A null URL, or one without ``://``, has an empty host and path, no tokens, and is allowed.
Repeated rows are judged alike (URLs are matched once per distinct value). Labels that are
null on both columns are ignored; several labels of one page count as bad if any is. Without
labelled pages there are no mined rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lower_ascii, written

@dataclass(frozen=True)
class UrlRule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit_rule(host: Column, path: Column, rules: Sequence[UrlRule], what: str) -> Column:
    """``what`` ("text" or "action") of the longest rule that fits, else NULL."""
    cases = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(getattr(r, what)))
             for r in sorted(rules, key=lambda r: -len(r.text))]
    return F.coalesce(*cases) if cases else F.lit(None).cast("string")


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels ``h:``, path words ``p:`` (numbers become #), query keys ``q:``."""
    def tagged(tag: str, parts: Column) -> Column:
        return F.transform(F.array_remove(parts, ""), lambda x: F.concat(F.lit(tag), x))

    words = F.transform(F.split(path, "[^A-Za-z0-9]+"), lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(x))
    query = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))
    return F.array_distinct(F.concat(tagged("h:", F.split(host, r"\.")), tagged("p:", words), tagged("q:", keys)))


def mining_items(bad_pages: DataFrame, min_bad: int) -> DataFrame:
    """(id, items) of bad pages (id, tokens): their tokens that at least ``min_bad`` of them hold."""
    place = bad_pages.select("id", F.explode("tokens").alias("token"))
    common = place.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= min_bad)
    return place.join(common, "token").groupBy("id").agg(F.array_sort(F.collect_list("token")).alias("items"))


def level_rules(transactions: DataFrame, min_bad: int, min_confidence: float) -> DataFrame:
    """Rules (tokens, n_bad, n_all) without redundant ones, level by level, for pages of many tokens.

    A set goes on to the next level while it is no rule, enough bad pages hold it, and more pages hold each smaller set
    inside it: else it is a rule only where that smaller set is one, which makes it redundant.
    """
    both = [F.count_if("bad").alias("n_bad"), F.count("*").alias("n_all")]
    held = transactions.select("id", "bad", F.explode("tokens").alias("token")).select("id", "bad", F.array("token").alias("tokens"))
    counts = written(held.groupBy("tokens").agg(*both).where(F.col("n_bad") >= min_bad), "level-1")
    rules, level = [], 1
    while True:
        confident = F.col("n_bad") >= min_confidence * F.col("n_all")
        rules.append(counts.where(confident))
        unsettled = counts.where(~confident).select("tokens", "n_all")
        if unsettled.limit(2).count() < 2:
            break
        held = written(held.join(unsettled.select("tokens"), "tokens"), f"held-{level}")
        # two sets of a page that differ in their last token only make one of the next level
        left = held.select("id", "bad", F.slice("tokens", 1, level - 1).alias("head"), F.element_at("tokens", -1).alias("a"))
        right = left.select("id", "head", F.col("a").alias("b"))
        wider = left.join(right, ["id", "head"]).where("a < b").select("id", "bad", F.concat("head", F.array("a", "b")).alias("tokens"))
        level += 1
        found = written(wider.groupBy("tokens").agg(*both).where(F.col("n_bad") >= min_bad), f"found-{level}")
        inside = found.select(F.col("tokens").alias("wide"), F.col("n_all").alias("n"), F.explode("tokens").alias("x")).select(
            "wide", "n", F.array_remove("wide", F.col("x")).alias("tokens"))
        fit = (inside.join(unsettled, "tokens").where(F.col("n_all") > F.col("n"))
               .groupBy(F.col("wide").alias("tokens")).agg(F.count("*").alias("k")).where(F.col("k") == level).select("tokens"))
        counts, held = written(found.join(fit, "tokens"), f"level-{level}"), wider
    return reduce(DataFrame.unionByName, rules)


def counted_rules(rules: DataFrame, transactions: DataFrame) -> DataFrame:
    """``rules`` (tokens, n_bad) with n_all, the number of transactions that hold all their tokens."""
    index = rule_index(rules, transactions)
    held = (transactions.select("id", "tokens", F.explode("tokens").alias("token")).join(index, "token")
            .where(F.forall("rule_tokens", lambda t: F.array_contains("tokens", t))))
    return rules.join(held.groupBy(F.col("rule_tokens").alias("tokens")).agg(F.count("*").alias("n_all")), "tokens")


def without_redundant(rules: DataFrame, transactions: DataFrame) -> DataFrame:
    """``rules`` that hold no other rule."""
    index = rule_index(rules, transactions)
    wider = (rules.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
             .where((F.size("rule_tokens") < F.size("tokens")) & F.forall("rule_tokens", lambda t: F.array_contains("tokens", t)))
             .select("tokens").distinct())
    return rules.join(wider, "tokens", "left_anti")


def mine_rules(transactions: DataFrame, min_bad: int = 3, min_confidence: float = 0.5, most_tokens: int = 12) -> DataFrame:
    """Rules (tokens array<string>, n_bad, n_all) "tokens -> bad" without redundant ones.

    ``transactions``: one row per labelled page with ``id``, ``tokens`` and ``bad`` boolean.
    """
    items = mining_items(transactions.where("bad"), min_bad).select("items")
    n, most = items.agg(F.count("*"), F.max(F.size("items"))).first()
    if (most or 0) > most_tokens:
        return level_rules(transactions, min_bad, min_confidence)
    # half a page below the bound, so rounding the share back to a count gives the bound
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_bad - 0.5) / max(n, 1)), minConfidence=1.0).fit(items)
    sets = model.freqItemsets.where(F.col("freq") >= min_bad).select(F.array_sort("items").alias("tokens"))
    sets = written(sets, "sets")
    n_bad = counted_rules(sets, transactions.where("bad")).withColumnRenamed("n_all", "n_bad")
    rules = written(counted_rules(n_bad, transactions).where(F.col("n_bad") >= min_confidence * F.col("n_all")), "rules")
    return without_redundant(rules, transactions)


def rule_index(rules: DataFrame, transactions: DataFrame) -> DataFrame:
    """Inverted index (token, rule_tokens): each rule under its rarest token in ``transactions``."""
    frequency = transactions.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return (rules.select(F.col("tokens").alias("rule_tokens"), F.explode("tokens").alias("token"))
            .join(frequency, "token")
            .groupBy("rule_tokens").agg(F.min_by("token", F.struct("n", "token")).alias("token")))


def matched_urls(urls: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct ``url`` values that contain every token of some rule."""
    return (urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
            .where(F.forall("rule_tokens", lambda t: F.array_contains("tokens", t)))
            .select("url").distinct())


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, bad, tokens) of every labelled row of ``pages`` (page_id, url) whose URL has tokens."""
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), (F.col("quality") == 0), (F.col("toxic") == 1))
    marked = (labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where("bad is not null")
              .groupBy("page_id").agg(F.max("bad").alias("bad")))
    known = (pages.select("page_id", "url", host.alias("host"), path.alias("path")).join(marked, "page_id")
             .select("bad", url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")).where(F.size("tokens") > 0))
    return written(known.select(F.monotonically_increasing_id().alias("id"), "bad", "tokens"), "labelled")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[UrlRule], min_bad: int = 3,
               min_confidence: float = 0.5, most_tokens: int = 12) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule and verdict.

    ``labels`` (doc_id, quality, toxic) name pages by id; bad means quality 0 or toxic 1.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")
    known = labelled_pages(pages, labels)
    index = rule_index(mine_rules(known, min_bad, min_confidence, most_tokens), known)
    # hosts and paths that an explicit rule decides need no match
    open_urls = (parts.where(explicit_rule(F.col("host"), F.col("path"), rules, "action").isNull())
                 .where("url is not null").select("url", "host", "path").distinct().select("url", tokens))
    hits = matched_urls(open_urls, index).withColumn("__hit", F.lit(True))
    mined = F.when(F.col("__hit"), F.lit("block")).otherwise(F.lit("allow"))
    # null URLs match nothing and stay out of the join
    joined = (parts.where("url is not null").join(hits, "url", "left")
              .unionByName(parts.where("url is null").withColumn("__hit", F.lit(None).cast("boolean"))))
    return joined.select("page_id", "host", "path", explicit_rule(F.col("host"), F.col("path"), rules, "text").alias("rule"),
                         F.coalesce(explicit_rule(F.col("host"), F.col("path"), rules, "action"), mined).alias("verdict"))

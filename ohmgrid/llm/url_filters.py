"""URL filters from association rules (operator 4).

FP-growth mines combinations of URL tokens among the pages with a bad label;
those that pass the support and confidence limits over all labelled pages are
rules, which are matched through an inverted index. Explicit allow and block
rules come first. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, forget, once, table, using, written

#: Frequent tokens of a page up to which FP-growth mines (it lists all subsets); with longer pages, subsets are counted by size.
MOST_TOKENS = 16
#: Rules, and URLs that rules fire for, up to which their table is broadcast; beyond, the join shuffles.
MOST_BROADCAST = 200_000


@dataclass(frozen=True)
class Rule:
    """An explicit rule such as ``block net/de/``: host, then path with its slash."""

    action: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1] if "/" in self.pattern else ""


RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null or a text without ``://``."""
    rest = F.coalesce(after_scheme(url), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def explicit(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct of the longest rule that fits: pattern and action; null without one.

    Of rules equally long the first in the order of their text wins.
    """
    found: Column | None = None
    for r in sorted(rules, key=lambda r: (-len(r.pattern), r.pattern, r.action)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.pattern).alias("rule"), F.lit(r.action).alias("action"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,action:string>")


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host, site, words of all the host's labels but the last, path pieces, query keys and arguments.

    Digits count by their number only, so that ids of pages do not each make a
    token. The host's last two labels are its site.
    """
    u = F.coalesce(url, F.lit(""))
    host, path = url_parts(u)
    scheme = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    shape = lambda x: F.regexp_replace(F.lower(x), r"[0-9]+", "9")
    words = F.transform(F.split(F.regexp_replace(host, r"\.?[^.]*$", ""), r"[^a-z0-9]+", -1), lambda x: F.concat(F.lit("word="), x))
    parts = F.transform(F.split(path, r"/+", -1), lambda x: F.concat(F.lit("path="), shape(x)))
    keys = F.transform(F.regexp_extract_all(query, F.lit(r"([^=&]+)=?[^&]*"), F.lit(1)), lambda x: F.concat(F.lit("key="), F.lower(x)))
    args = F.transform(F.regexp_extract_all(query, F.lit(r"([^=&]+=[^&]+)"), F.lit(1)), lambda x: F.concat(F.lit("arg="), shape(x)))
    single = F.array(F.concat(F.lit("scheme="), F.lower(scheme)), F.concat(F.lit("host="), host), F.concat(F.lit("site="), F.regexp_extract(host, r"[^.]*\.[^.]*$", 0)))
    return F.filter(F.array_distinct(F.concat(single, words, parts, keys, args)), lambda x: ~x.rlike(r"^[a-z]+=$"))


def small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def combinations(tokens: Column, size: int) -> Column:
    """All ascending arrays of ``size`` tokens of a sorted array of distinct ones."""
    out = F.transform(tokens, lambda x: F.array(x))
    for _ in range(size - 1):
        out = F.flatten(F.transform(out, lambda c: F.transform(F.filter(tokens, lambda y: y > F.element_at(c, -1)), lambda y: F.array_append(c, y))))
    return out


def mine(pages: DataFrame, labels: DataFrame, support: float = 0.0, confidence: float = 0.5, lift: float = 1.5, items: int = 3, least: int = 20) -> DataFrame:
    """Rules (antecedent array, rarest token of it, confidence, support, lift) for a bad label.

    ``pages``: page_id, url; ``labels``: doc_id (the page's id), quality, toxic.
    Bad is quality 0 or toxic 1; a page with null in both has no label. An
    antecedent has at most ``items`` tokens and holds for ``least`` bad pages at
    least, however many pages are labelled; ``support`` can ask for a share of
    the labelled pages besides. FP-growth finds all such combinations among the
    tokens of the bad pages; where a page has more than ``MOST_TOKENS`` tokens
    that are frequent, whose subsets it would all list, the same combinations
    are counted by size. No labels or no tokens give no rules.
    """
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.col("quality") == 0, F.col("toxic") == 1)
    known = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where("bad is not null and page_id is not null")
    known = known.groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = pages.select("page_id", "url").join(known, "page_id").select(F.monotonically_increasing_id().alias("row"), url_tokens(F.col("url")).alias("tokens"), F.col("bad").cast("int").alias("bad"))
    rows = written(rows, "url-baskets")
    n, n_bad = rows.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    needed = max(least, support * n, 1)
    counts = rows.select("bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("bad").alias("both"), F.count("*").alias("n"))
    single = written(counts.where(F.col("both") >= needed), "url-tokens")
    frequent = rows.select("row", "bad", F.explode("tokens").alias("token")).join(small(single), "token").groupBy("row", "bad").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    frequent = written(frequent, "url-frequent")
    baskets = frequent.where("bad = 1").select("tokens")
    longest = baskets.agg(F.max(F.size("tokens"))).first()[0] or 0
    if longest <= MOST_TOKENS and n_bad >= needed:
        mined = FPGrowth(itemsCol="tokens", minSupport=min(1.0, (needed - 0.5) / max(1, baskets.count()))).fit(baskets).freqItemsets
        sets = mined.where(F.size("items") <= items).select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("both"))
    else:
        sets = None
        for size in range(1, items + 1):
            more = baskets.select(F.explode(combinations(F.col("tokens"), size)).alias("antecedent")).groupBy("antecedent").agg(F.count("*").alias("both"))
            sets = more if sets is None else sets.unionByName(more)
    sets = written(sets.where(F.col("both") >= needed), "url-sets")
    rare = sets.select("antecedent", "both", F.explode("antecedent").alias("token")).join(small(single.select("token", F.col("n").alias("tn"))), "token")
    rare = written(rare.groupBy("antecedent").agg(F.max("both").alias("both"), F.min_by("token", F.struct("tn", "token")).alias("token")), "url-index")
    held = frequent.select("tokens", F.explode("tokens").alias("token")).join(small(rare), "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    found = held.groupBy("antecedent", "token", "both").agg(F.count("*").alias("n"))
    sure = F.col("both") / F.col("n")
    found = found.select("antecedent", "token", sure.alias("confidence"), (F.col("both") / F.lit(max(n, 1))).alias("support"), (sure * n / F.lit(max(n_bad, 1))).alias("lift"))
    rules = written(found.where((F.col("confidence") >= confidence) & (F.col("lift") >= lift)), "url-rules")
    forget(rows, single, frequent, sets, rare)
    return rules


def blocked(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct values of ``url`` that a rule fires for.

    The index has each rule under its rarest token, so a URL meets a rule once at
    most and tokens that nearly all URLs have lead to few rules; the rest of the
    antecedent is checked on the row.
    """
    index = small(rules.select("antecedent", "token"))
    tokens = urls.select("url").where("url is not null").distinct().withColumn("tokens", once(url_tokens(F.col("url"))))
    hits = tokens.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hits.select("url").distinct()


def url_filters(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, **limits: float) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``.

    The longest explicit rule decides, of equally long ones the first by text;
    else a mined rule that fires blocks; else the page is allowed. A null URL has
    an empty host and path and is allowed, an empty one too, and a very long one
    is taken whole. Verdicts depend on the URL alone, so repeated rows and rows
    with a null page_id get theirs too. Other columns are not read, whatever
    their names. An empty table gives an empty result.
    """
    pages = pages.select("page_id", "url")
    found = mine(pages, labels, **limits)
    hits = written(blocked(pages, found).withColumn("__hit", F.lit(True)), "url-hits")
    forget(found)
    host, path = url_parts(F.col("url"))
    # null URLs meet nothing; they are spread by their id
    place = F.when(F.col("url").isNull(), F.concat(F.lit("0"), F.xxhash64("page_id").cast("string"))).otherwise(F.concat(F.lit("1"), F.col("url")))
    out = pages.withColumn("__at", place).join(small(hits.select(F.concat(F.lit("1"), F.col("url")).alias("__at"), "__hit")), "__at", "left").select("page_id", host.alias("host"), path.alias("path"), F.col("__hit"))
    out = out.withColumn("__rule", explicit(F.col("host"), F.col("path"), rules))
    mined = F.when(F.coalesce(F.col("__hit"), F.lit(False)), "block").otherwise("allow")
    return using(out.select("page_id", "host", "path", F.col("__rule")["rule"].alias("rule"), F.coalesce(F.col("__rule")["action"], mined).alias("verdict"), F.coalesce(F.col("__hit"), F.lit(False)).alias("mined_hit")), hits)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))

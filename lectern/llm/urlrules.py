"""URL filtering by a list of rules and, where none fits, by association rules that FP-growth mines from labelled URLs.

A URL's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; its path is what follows
up to ``?``, ``#`` or the end.  A rule (host, path) fits its host and all subdomains if the path starts with the rule's; the
longest rule wins, by host and path together, then by host, then the greater verdict.

The method: a URL becomes a set of tokens (labels of the host by their depth, parts of labels with hyphens, path segments and
query keys with digits folded, fragment).  Spark's FP-growth finds the frequent combinations of tokens and a label; what is
left after pruning by support and confidence are rules "these tokens, so this label".  Each rule is entered in an inverted index
under its rarest token.  The distinct token sets of the URLs to judge look their tokens up there, what they find is verified,
and the rule with the highest confidence decides (then support, then fewer tokens, then tokens and label by code point).
Where no rule fires, the most frequent label decides.

Everything runs in Spark's expressions and joins.  The driver gets the number of labelled rows, the most frequent label and the
tokens that nearly all labelled URLs share (at most the mean number of tokens divided by that share).  URLs with the same tokens
are one row before any join, so a host that holds a third of all pages weighs no more than another; the judged table is joined
back with that small table by its size (broadcast) or with Spark's skew handling.  Labels are counted over all labelled rows.

A null URL, and one without ``://``, has an empty host and path, no tokens and the most frequent label.  Repeated pages are
judged alike, each in a row of its own; without any label all are allowed; other columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.runtime import discard, shuffle_width, spill

#: Least share of labelled rows, and least number of them, that a rule's tokens and label share.
SUPPORT, LEAST_ROWS = 0.001, 5
CONFIDENCE = 0.7
#: Most tokens of a rule.
LONGEST = 3
#: Tokens of more than this share of the labelled rows tell nothing and are left out.
MOST_SHARE = 0.95
#: Verdict where nothing is known at all.
ALLOW = "allow"
#: Longest list of rules that is tried one by one in an expression; longer ones are joined.
MOST_LISTED = 64

_LABEL = "label="


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL in order; none for one without ``://``."""
    rest = _rest(url)
    folded = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    labels = F.split(host(url), r"\.")
    words = F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    kinds = [
        F.transform(F.filter(F.transform(F.reverse(labels), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"] != ""), lambda s: F.concat(F.lit("h"), s["i"], F.lit("="), s["x"])),
        F.transform(F.filter(words, lambda x: x != ""), lambda x: F.concat(F.lit("w="), x)),
        F.transform(F.filter(F.split(path(url), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p="), folded(x))),
        F.transform(F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != ""), lambda x: F.concat(F.lit("q="), folded(x))),
        F.when(rest.contains("#"), F.array(F.concat(F.lit("f="), folded(F.regexp_extract(rest, r"#([^#]*)", 1))))).otherwise(F.array().cast("array<string>")),
    ]
    return F.array_sort(F.array_distinct(F.concat(*kinds)))


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The text and the verdict of the longest of ``rules`` (host, path, verdict) that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        text, verdict = F.when(fits, F.lit(name + start)).otherwise(text), F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def joined_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for any number of rules: the distinct (host, path) of ``urls`` that a rule fits, with rule and verdict.

    Each pair looks up all endings of its host with all starts of its path that have the length of some rule's path.  The
    driver gets these lengths; there are at most as many as the longest path of a rule has characters.
    """
    rules = rules.select(F.col("host").alias("_host"), F.col("path").alias("_start"), F.col("verdict").alias("_verdict")).where("_host is not null and _start is not null")
    lengths = [r[0] for r in rules.select(F.length("_start")).distinct().collect()]
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]).cast("array<string>")
    keys = pairs.select("host", "path", F.explode(ends).alias("_host")).select("*", F.explode(F.filter(starts, lambda x: x.isNotNull())).alias("_start"))
    best = F.max(F.struct((F.length("_host") + F.length("_start")).alias("n"), F.length("_host").alias("h"), F.concat("_host", "_start").alias("rule"), F.col("_verdict").alias("verdict")))
    return keys.join(rules, ["_host", "_start"]).groupBy("host", "path").agg(best.alias("_best")).select("host", "path", "_best.rule", "_best.verdict")


def with_rules(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """``urls`` (with host and path) with the columns rule and verdict."""
    if isinstance(rules, list) and len(rules) <= MOST_LISTED:
        rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
        return urls.select("*", rule.alias("rule"), verdict.alias("verdict"))
    if isinstance(rules, list):
        rules = urls.sparkSession.createDataFrame(rules, "host string, path string, verdict string")
    found = joined_rules(urls, rules).select(F.col("host").alias("_h"), F.col("path").alias("_p"), "rule", "verdict")
    return urls.join(found, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").drop("_h", "_p")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, longest: int = LONGEST, least: int = LEAST_ROWS) -> DataFrame:
    """Rules (items, label, n, confidence, key) from rows (tokens, label); ``key`` is the rarest of the items."""
    spark = labelled.sparkSession
    schema = "items array<string>, label string, n long, confidence double, key string"
    labelled = labelled.where(F.col("label").isNotNull()).select("tokens", "label")
    n = labelled.count()
    floor = max(least, math.ceil(support * n))
    if n < floor:
        return spark.createDataFrame([], schema)
    seen = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    common = [r.token for r in seen.where(F.col("n") > MOST_SHARE * n).collect()]
    items = F.array_except("tokens", F.array(*[F.lit(t) for t in common]).cast("array<string>"))
    rows = labelled.select(F.concat(items, F.array(F.concat(F.lit(_LABEL), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(floor - 0.5) / n, numPartitions=shuffle_width(spark)).fit(rows)
    sets = spill(model.freqItemsets.where(F.size("items") <= longest + 1).select(F.array_sort("items").alias("items"), F.col("freq").alias("n")))
    is_label = lambda x: x.startswith(_LABEL)
    said = sets.select(F.filter("items", is_label).alias("labels"), F.filter("items", lambda x: ~is_label(x)).alias("items"), "n")
    said = said.where("size(labels) = 1 and size(items) > 0").select("items", F.substring(F.col("labels")[0], len(_LABEL) + 1, 1 << 30).alias("label"), "n")
    plain = sets.where(~F.exists("items", is_label)).select(F.col("items").alias("_items"), F.col("n").alias("_n"))
    sure = said.join(plain, F.col("items") == F.col("_items")).where(F.col("n") / F.col("_n") >= confidence)
    sure = sure.select("items", "label", "n", (F.col("n") / F.col("_n")).alias("confidence"))
    one = plain.where("size(_items) = 1").select(F.col("_items")[0].alias("_token"), "_n")
    keyed = sure.select("*", F.explode("items").alias("_item")).join(one, F.col("_item") == F.col("_token")).groupBy("items", "label", "n", "confidence").agg(F.min(F.struct("_n", "_token"))["_token"].alias("key"))
    found = spill(keyed)
    discard(sets)
    return found


def decide(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``sets`` (tokens) for which a rule fires, with its label, confidence and items."""
    entries = rules.select("items", "label", "n", "confidence", "key")
    asked = sets.select("tokens").distinct().select("tokens", F.explode("tokens").alias("_token"))
    met = asked.join(entries, F.col("_token") == F.col("key")).where(F.size(F.array_except("items", "tokens")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("n")).alias("n"), F.size("items").alias("k"), F.array_join("items", " ").alias("because"), F.col("label")))
    return met.groupBy("tokens").agg(best.alias("b")).select("tokens", F.col("b.label").alias("label"), (-F.col("b.c")).alias("confidence"), F.col("b.because").alias("because"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_column: str = "page_id", labels: DataFrame | None = None, support: float = SUPPORT, confidence: float = CONFIDENCE, longest: int = LONGEST, least: int = LEAST_ROWS) -> DataFrame:
    """Every row of ``pages`` with host, path, rule, verdict, and for mined verdicts their confidence and tokens (because).

    ``labels`` (url, label) is what the method learns from; by default the pages that a rule decides, with its verdict.
    """
    url = F.col("url").cast("string")
    urls = pages.select(F.col(id_column), host(url).alias("host"), path(url).alias("path"), tokens(url).alias("tokens"))
    ruled = with_rules(urls, rules)
    if labels is None:
        known = ruled.where(F.col("verdict").isNotNull()).select("tokens", F.col("verdict").alias("label"))
    else:
        known = labels.select(tokens(F.col("url").cast("string")).alias("tokens"), "label")
    known = spill(known.where(F.col("label").isNotNull()))
    top = known.groupBy("label").count().orderBy(F.desc("count"), "label").head()
    mined = mine(known, support, confidence, longest, least)
    discard(known)
    decided = spill(decide(ruled.where("verdict is null"), mined)).withColumnRenamed("tokens", "_tokens")
    open_ = F.col("verdict").isNull()
    judged = ruled.join(decided, F.col("tokens") == F.col("_tokens"), "left")
    return judged.select(id_column, "host", "path", "rule", F.coalesce("verdict", "label", F.lit(top.label if top else ALLOW)).alias("verdict"), F.when(open_, F.col("confidence")).alias("confidence"), F.when(open_, F.col("because")).alias("because"))

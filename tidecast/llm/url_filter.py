"""URL filter: allow and block rules, and gradient-boosted trees on lexical features for the rest.

The URLs that rules decide are the labelled ones; the trees learn what they look like.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.boosted import fit_boosted
from tidecast.llm.common import broadcast_up_to
from tidecast.staging import stage

FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digit_ratio", "hyphens", "entropy", "host_entropy", "params", "has_fragment", "secure", "suffix_rate", "domain_rate", "folder_rate")
# Suffix rates are drawn to the overall rate as if so many labelled URLs more had been seen.
PRIOR = 10.0
# Rows of a suffix table that may be broadcast.
MOST_SUFFIXES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: Sequence[Rule]) -> Column:
    """Struct (length, rule, verdict) of the longest rule that fits columns host and path, else null.

    Rules (verdict, host, path) are a list that the plan holds; of equally long ones the later in
    the alphabet wins.
    """
    fits = [F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p),
                   F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))) for verdict, h, p in rules]
    return F.greatest(*fits, F.lit(None), F.lit(None)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.greatest(F.lit(1), F.char_length(text)).cast("double")
    share = lambda c: (F.char_length(text) - F.char_length(F.replace(text, c, F.lit("")))) / size
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a - F.when(c != "", share(c) * F.log2(share(c))).otherwise(0.0))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that a URL alone has, and its suffix, domain and first folder."""
    url, h, p = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    size = F.greatest(F.lit(1), F.char_length(url))
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns({
        "length": F.char_length(url).cast("double"), "host_length": F.char_length(h).cast("double"), "path_length": F.char_length(p).cast("double"),
        "labels": count(h, r"[^.]+"), "depth": count(p, r"[^/]+"), "digit_ratio": count(url, "[0-9]") / size, "hyphens": count(h, "-"),
        "entropy": _entropy(url), "host_entropy": _entropy(h), "params": count(query, "[^&;]+"),
        "has_fragment": url.contains("#").cast("double"), "secure": url.startswith("https:").cast("double"),
        "suffix": F.substring_index(h, ".", -1), "domain": F.substring_index(h, ".", -2), "folder": F.substring_index(F.substring_index(p, "/", 2), "/", -1),
    })


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score): one row per row of ``pages``.

    The verdict is that of the longest rule that fits; else block if the trees give it at least
    0.5. Suffix, domain and folder rates are shares of blocked URLs among the labelled ones that
    have them, a labelled URL's own label left out. Null URLs and those without ``://`` have an
    empty host and path. If rules decide no URL, all are allowed; if all alike, the rest follow.
    Repeated rows give a row each. Other columns are not looked at.
    """
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    decided = urls.withColumn("_rule", rule_of(rules)).withColumn("label", (F.col("_rule.verdict") == "block").cast("double"))
    table = stage(lexical(decided), "urls")
    whole = table.agg(F.coalesce(F.avg("label"), F.lit(0.0)).alias("rate")).first()["rate"]
    for level in ("suffix", "domain", "folder"):
        rates = stage(table.where("label is not null").groupBy(level).agg(F.sum("label").alias("_blocked"), F.count("*").alias("_seen")), level)
        own, once = F.coalesce("label", F.lit(0.0)), F.col("label").isNotNull().cast("double")
        table = table.join(broadcast_up_to(rates, MOST_SUFFIXES), level, "left").withColumn(
            f"{level}_rate", (F.coalesce("_blocked", F.lit(0)) - own + PRIOR * whole) / (F.coalesce("_seen", F.lit(0)) - once + PRIOR)).drop("_blocked", "_seen")
    table = stage(table, "url_features")
    scored = fit_boosted(table.where("label is not null"), FEATURES, "label").score(table)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")

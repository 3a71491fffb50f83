"""URL filters: rules by host and path, and gradient-boosted trees over lexical features.

A rule fits its host and all hosts below it, for paths that begin with the rule's path; the longest fitting rule decides.
Other URLs are judged by boosted trees over their length, depth, shares of digits and marks, character entropy, numbers of
parameters, and what the labelled URLs say of their suffixes. Labelled URLs are given, or are those that rules decide.

Labels are taken by distinct URL: one labelled both ways counts as to block if at least half of its rows do. What suffixes
say is counted over all labelled URLs and joined by suffix; for training, without the URL's own label. The trees are trained on at
most ``TRAIN_ROWS`` labelled URLs, half of them for each label, those with the least hashes, weighted by how many URLs they
stand for; every URL is judged.

Defined results: a null URL, or one without ``://``, has an empty host and path; without labels of both kinds every
URL without a rule is allowed; repeated rows are judged alike; other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintally.sources.staging import stage

TRAIN_ROWS = 4000
TREES = 12
DEPTH = 4
#: Weight of the overall share of blocked URLs in that of a suffix.
PRIOR = 5.0
FEATURES = ["n_chars", "host_chars", "path_chars", "depth", "labels", "digit_share", "mark_share", "entropy", "params", "param_chars", "secure", "top_blocked", "site_blocked"]


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits; null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def share(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path) with the features that need nothing but the URL, and the suffixes ``top`` and ``site``."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    chars = F.split(url, "")
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars))
    return urls.withColumns(
        {
            "n_chars": F.length(url),
            "host_chars": F.length(host),
            "path_chars": F.length(path),
            "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
            "labels": F.size(F.split(host, r"\.")),
            "digit_share": share(url, "[^0-9]"),
            "mark_share": share(url, "[^-_%~+=&.]"),
            "entropy": -F.aggregate(shares, F.lit(0.0), lambda a, p: a + p * F.log2(p)),
            "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
            "param_chars": F.length(query),
            "secure": url.startswith("https").cast("int"),
            "top": F.substring_index(host, ".", -1),
            "site": F.substring_index(host, ".", -2),
        }
    )


def suffix_counts(known: DataFrame, suffix: str) -> DataFrame:
    """(suffix, suffix_sum, suffix_n): the labels of the labelled URLs with each suffix, and their number."""
    return known.groupBy(suffix).agg(F.sum("label").alias(f"{suffix}_sum"), F.count("*").alias(f"{suffix}_n"))


def featured(urls: DataFrame, counts: dict[str, DataFrame], mean: float, own: bool) -> DataFrame:
    """``urls`` (lexical) with the shares of their suffixes, drawn towards the share of all; ``own``: without their own label."""
    for suffix, counted in counts.items():
        urls = urls.join(counted, suffix, "left")
        total, n = F.coalesce(f"{suffix}_sum", F.lit(0.0)), F.coalesce(f"{suffix}_n", F.lit(0))
        if own:
            total, n = total - F.col("label"), n - 1
        urls = urls.withColumn(f"{suffix}_blocked", (total + PRIOR * mean) / (n + PRIOR))
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(urls)


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict and ``blocked`` (the trees' probability; null where a rule decides).

    ``labelled`` (url, label: 1 for block) are URLs to learn from.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = rows.where("ruled IS NOT NULL").select("url", "host", "path", (F.col("ruled.verdict") == "block").cast("double").alias("label"))
    else:
        known = labelled.where("url IS NOT NULL AND label IS NOT NULL").select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double").alias("label"))
    out = [F.col("id").alias(id_col), "host", "path", F.col("ruled.rule").alias("rule")]
    known = known.groupBy("url", "host", "path").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    known = stage(lexical(known), "labelled-urls")
    numbers = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(numbers) < 2:
        return rows.select(*out, F.coalesce("ruled.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("blocked"))
    mean = numbers[1.0] / (numbers[0.0] + numbers[1.0])
    counts = {suffix: stage(suffix_counts(known, suffix), "suffixes") for suffix in ("top", "site")}
    most = TRAIN_ROWS // 2
    samples = [known.where(F.col("label") == k).orderBy(F.xxhash64("url"), "url").limit(most).withColumn("weight", F.lit(n / min(n, most))) for k, n in numbers.items()]
    train = featured(samples[0].unionByName(samples[1]), counts, mean, own=True)
    model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(train.select("features", "label", "weight"))
    judged = model.transform(featured(lexical(rows), counts, mean, own=False)).withColumn("p", vector_to_array("probability")[1])
    verdict = F.coalesce("ruled.verdict", F.when(F.col("p") > 0.5, "block").otherwise("allow"))
    return judged.select(*out, verdict.alias("verdict"), F.when(F.col("ruled").isNull(), F.col("p")).alias("blocked"))

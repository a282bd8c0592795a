"""URL filter: rules first, then boosted trees on lexical features.

Rules name a host, its subdomains and the beginning of a path.  URLs that a rule
fits are the labelled ones; gradient-boosted trees learn from them and judge the
rest.  Everything is DataFrame expressions and MLlib; nothing runs in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import ascii_lower, stored


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Host and path rules (fixed values).
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Labelled URLs that the trees are fitted on at most: those that hash lowest.
SAMPLE = 20_000
TREES, DEPTH = 12, 4
#: Rows that a suffix's share of blocked URLs is drawn towards the average by.
PRIOR = 20.0

FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits",
            "hyphens", "entropy", "parameters", "query_length", "has_fragment", "has_extension",
            "secure", "suffix_share", "suffix_blocked", "first_segment_length"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Name of the longest rule that fits, else null; ``rules`` is a short configured list."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the features that a URL's text alone gives; ``text`` is the URL or empty."""
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    size = F.greatest(F.length("text"), F.lit(1))
    query = F.regexp_extract("text", r"\?([^#]*)", 1)
    share = F.expr("""aggregate(array_distinct(chars), 0D, (s, c) ->
        s - (size(filter(chars, x -> x = c)) / size(chars)) * log2(size(filter(chars, x -> x = c)) / size(chars)))""")
    return (pages.withColumn("chars", chars)
            .withColumn("url_length", F.length("text").cast("double"))
            .withColumn("host_length", F.length("host").cast("double"))
            .withColumn("path_length", F.length("path").cast("double"))
            .withColumn("depth", F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"))
            .withColumn("labels", F.size(F.split("host", r"\.")).cast("double"))
            .withColumn("digit_ratio", F.regexp_count("text", F.lit("[0-9]")) / size)
            .withColumn("host_digits", F.regexp_count("host", F.lit("[0-9]")).cast("double"))
            .withColumn("hyphens", F.regexp_count("host", F.lit("-")).cast("double"))
            .withColumn("entropy", share)
            .withColumn("parameters", F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"))
            .withColumn("query_length", F.length(query).cast("double"))
            .withColumn("has_fragment", F.contains("text", F.lit("#")).cast("double"))
            .withColumn("has_extension", F.rlike("path", F.lit(r"\.[A-Za-z0-9]{2,5}$")).cast("double"))
            .withColumn("secure", F.startswith("text", F.lit("https:")).cast("double"))
            .withColumn("first_segment_length", F.length(F.regexp_extract("path", r"^/([^/]*)", 1)).cast("double"))
            .drop("chars"))


def judged_urls(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, block_score.

    The verdict is the longest fitting rule's, else ``block`` where the trees give
    blocking more than one half.  block_score is null where a rule decides.  A null
    url, or one without ``://``, has empty host and path, fits no rule and is judged
    by its text like any other.  Without labelled URLs the rest is allowed; if all
    labels agree, the rest gets that verdict.  Suffix statistics are counted over
    all rows; repeated rows are judged alike.  Only page_id and url are read.
    """
    texts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("text"))
    split = (texts.withColumn("host", host_of(F.col("text"))).withColumn("path", path_of(F.col("text")))
             .withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
             .withColumn("suffix", F.substring_index("host", ".", -1)))
    blocking = [r.name for r in rules if r.verdict == "block"]
    label = F.when(F.col("rule").isin(blocking), 1.0).when(F.col("rule").isNotNull(), 0.0)
    named = stored(lexical(split).withColumn("label", label), "urls")

    suffixes = named.groupBy("suffix").agg(
        F.count("*").alias("rows"), F.count("label").alias("known"), F.sum("label").alias("blocked"))
    total = named.agg(F.count("*").alias("n"), F.avg("label").alias("rate")).first()
    n, rate = total["n"] or 1, total["rate"]
    statistics = suffixes.select(
        F.col("suffix"), (F.col("rows") / F.lit(float(n))).alias("suffix_share"),
        ((F.coalesce("blocked", F.lit(0.0)) + F.lit(PRIOR * (rate or 0.0))) / (F.col("known") + F.lit(PRIOR)))
        .alias("suffix_blocked"))
    full = named.join(statistics, "suffix")
    answer = full.select("page_id", "host", "path", "rule", "label", *FEATURES)
    if rate in (None, 0.0, 1.0):
        scored = answer.withColumn("p", F.lit(rate or 0.0))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
        labelled = (full.where("label IS NOT NULL")
                    .orderBy(F.xxhash64("text", "page_id"), "text", "page_id").limit(sample)
                    .select("label", *FEATURES))
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11, featuresCol="features",
                              labelCol="label").fit(vectors.transform(stored(labelled, "labelled-urls")))
        scored = trees.transform(vectors.transform(answer)).withColumn(
            "p", F.get(vector_to_array("probability"), F.lit(1)))
    learnt = F.when(F.col("p") > 0.5, "block").otherwise("allow")
    verdict = F.when(F.col("label") == 1, "block").when(F.col("label") == 0, "allow").otherwise(learnt)
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"),
                         F.when(F.col("label").isNull(), F.col("p")).alias("block_score"))

"""URL filters: host and path rules, and gradient-boosted trees over lexical features, in DataFrame functions and Spark ML only.

Up to ``INLINE_RULES`` rules (host, path) are compared as one expression, which
costs no shuffle; more are joined by the suffixes of the distinct hosts. Where no
rule fits, boosted trees decide by length, depth, digit ratio, entropy, parameter
counts, lengths of path elements and statistics of the host's suffixes and of the
first path element. They are trained from labelled URLs. The query takes the URLs
that rules decide as its labelled ones, so what its trees can learn is the rules'
own sites and first path elements.

Statistics count all labelled URLs. In training a URL sees those of the other four
fifths only, so a site that occurs once doesn't carry its own label. The trees are
fitted on distinct URLs, about ``TRAIN_ROWS`` / 2 of each label, and the two labels
weigh the same, whatever their shares.

Defined results: a null URL, or one without ``://``, has an empty host and path
and is judged by the trees; of rules of equal length that fit, ``block`` wins;
repeated rows are judged each; page_id may be null;
with labels of one kind only, that verdict is given, without any ``allow``;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.functions.vectors import bound
from lumenflow.llm.common import lower_ascii, small, stored, table

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: More rules than these are joined.
INLINE_RULES = 200
#: The trees learn from about so many distinct labelled URLs, chosen by a hash of the URL.
TRAIN_ROWS = 20_000
FOLDS = 5
_FEATURES = ["length", "host_length", "labels", "depth", "digits", "entropy", "parameters", "query_length", "hyphens", "path_length", "first_length", "last_length", "last_digits"]
#: What is counted over labelled URLs: top and second level of the host, and the first path element.
_COUNTED = ["top", "site", "first"]
_FEATURES += [f"{s}_{k}" for s in _COUNTED for k in ("share", "block")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits: struct<size, rule, verdict>, else null."""
    found = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*found) if len(found) > 1 else found[0]


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def entropy(text: Column) -> Column:
    """Bits for each sign: the signs are sorted once, and the runs of equal ones are their counts."""
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == 0) | (i == F.size(s)) | ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
    runs = lambda at: F.zip_with(F.slice(at, F.lit(2), F.size(at) - 1), F.slice(at, F.lit(1), F.size(at) - 1), lambda b, a: b - a)
    bits = lambda s: F.aggregate(bound(starts(s), runs), F.lit(0.0), lambda t, n: t - n / F.size(s) * F.log2(n / F.size(s)))
    return F.when(F.length(text) > 0, bound(F.array_sort(F.filter(F.split(text, ""), lambda c: c != "")), bits)).otherwise(0.0)


def with_features(urls: DataFrame) -> DataFrame:
    """Adds the lexical features of ``url`` (with host and path there already), but for the statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    last = F.substring_index("path", "/", -1)
    return urls.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "labels": _count(F.col("host"), ".").cast("double"),
            "depth": _count(F.col("path"), "/").cast("double"),
            "digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / size,
            "entropy": entropy(url),
            "parameters": (_count(query, "&") + F.when(query == "", 0).otherwise(1)).cast("double"),
            "query_length": F.length(query).cast("double"),
            "hyphens": _count(F.col("host"), "-").cast("double"),
            "path_length": F.length("path").cast("double"),
            "first": F.split_part("path", F.lit("/"), F.lit(2)),
            "last_length": F.length(last).cast("double"),
            "last_digits": F.length(F.regexp_replace(last, "[^0-9]", "")).cast("double"),
            "top": F.substring_index("host", ".", -1),
            "site": F.substring_index("host", ".", -2),
        }
    ).withColumn("first_length", F.length("first").cast("double"))


def with_matches(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds match, as ``matched_rule``, however many rules there are."""
    if not rules:
        return rows.withColumn("match", F.lit(None).cast("struct<size:int,rule:string,verdict:string>"))
    if len(rules) <= INLINE_RULES:
        return rows.withColumn("match", matched_rule(F.col("host"), F.col("path"), rules))
    table = rows.sparkSession.createDataFrame([(rule.partition("/")[0], "/" + rule.partition("/")[2], len(rule), rule, verdict) for verdict, rule in rules], "suffix string, start string, size int, rule string, verdict string")
    pages = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(labels, lambda _, k: F.array_join(F.slice(labels, k + 1, F.size(labels)), "."))
    fits = pages.withColumn("suffix", F.explode(F.array_distinct(suffixes))).join(table, "suffix").filter(F.startswith("path", F.col("start")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("size", "rule", "verdict")).alias("match"))
    return rows.join(best, ["host", "path"], "left")


def suffix_statistics(labelled: DataFrame, suffix: str) -> DataFrame:
    """Labelled URLs and blocked ones by suffix and fold."""
    return labelled.groupBy(suffix, "fold").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").alias("blocked"))


def _shares(n: Column, blocked: Column, suffix: str) -> list[Column]:
    return [F.log1p(F.coalesce(n, F.lit(0.0))).alias(f"{suffix}_share"), F.coalesce((blocked + 1.0) / (n + 2.0), F.lit(0.5)).alias(f"{suffix}_block")]


class UrlModel:
    """Boosted trees with the suffix statistics they were trained with."""

    def __init__(self, model, statistics: dict[str, DataFrame], only: str):
        self.model, self.statistics, self.only = model, statistics, only

    def joined(self, urls: DataFrame, out_of_fold: bool = False) -> DataFrame:
        """Adds the suffix statistics; of the other folds only, where the URLs are trained from."""
        for suffix, counts in self.statistics.items():
            total = counts.groupBy(suffix).agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
            if out_of_fold:
                own = counts.withColumnsRenamed({"n": "own_n", "blocked": "own_blocked"})
                total = own.join(total, suffix).select(suffix, "fold", *_shares(F.col("n") - F.col("own_n"), F.col("blocked") - F.col("own_blocked"), suffix))
                urls = urls.join(total, [suffix, "fold"], "left")
            else:
                urls = urls.join(small(stored(total.select(suffix, *_shares(F.col("n"), F.col("blocked"), suffix)), f"op2-{suffix}")), suffix, "left")
        return urls.na.fill({f"{s}_{k}": v for s in self.statistics for k, v in (("share", 0.0), ("block", 0.5))})

    def judge(self, urls: DataFrame) -> DataFrame:
        """Adds score (probability of block) and judged (allow or block)."""
        if self.model is None:
            return urls.withColumns({"score": F.lit(1.0 if self.only == "block" else 0.0), "judged": F.lit(self.only)})
        out = self.model.transform(VectorAssembler(inputCols=_FEATURES, outputCol="features").transform(self.joined(urls)))
        return out.withColumn("score", vector_to_array("probability")[1]).withColumn("judged", F.when(F.col("score") > 0.5, "block").otherwise("allow"))


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> UrlModel:
    """From labelled URLs with their features and ``label`` (1: block).

    What reaches Spark ML are about ``rows`` distinct URLs, half of each label
    where there are as many.
    """
    labelled = labelled.filter("label is not null").withColumn("fold", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)))
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.approx_count_distinct("url").alias("n")).collect()}
    if len(sizes) < 2:
        return UrlModel(None, {}, "block" if sizes.get(1.0) else "allow")
    draw = F.pmod(F.xxhash64("url"), F.lit(1 << 30))
    taken = F.lit(False)
    for label, n in sizes.items():
        taken = taken | ((F.col("label") == label) & (draw < int(min(1.0, rows / 2 / max(n, 1)) * (1 << 30))))
    statistics = {s: stored(suffix_statistics(labelled, s), f"op2-{s}") for s in _COUNTED}
    model = UrlModel(None, statistics, "allow")
    sample = stored(labelled.filter(taken).dropDuplicates(["url", "label"]), "op2-sample")
    features = VectorAssembler(inputCols=_FEATURES, outputCol="features").transform(model.joined(sample, out_of_fold=True))
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = F.when(F.col("label") == 1.0, sum(counts.values()) / (2.0 * max(1, counts.get(1.0, 0)))).otherwise(sum(counts.values()) / (2.0 * max(1, counts.get(0.0, 0))))
    fitted = stored(features.select(vector_to_array("features").alias("x"), "label", weight.alias("weight")), "op2-features")
    fitted = fitted.select(array_to_vector("x").alias("features"), "label", "weight").coalesce(4)
    model.model = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, seed=7, weightCol="weight").fit(fitted)
    return model


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score; ``labelled`` (url, label) defaults to the URLs that rules decide."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rows = with_matches(rows, rules)
    if labelled is None:
        known = rows.filter("match is not null").withColumn("label", F.when(F.col("match.verdict") == "block", 1.0).otherwise(0.0))
    else:
        h, p = split_url(F.col("url"))
        known = labelled.select("url", F.col("label").cast("double").alias("label")).withColumns({"host": h, "path": p})
    model = train(with_features(known))
    out = model.judge(with_features(rows))
    return out.select("page_id", "host", "path", F.col("match.rule").alias("rule"), F.coalesce("match.verdict", "judged").alias("verdict"), "score")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)

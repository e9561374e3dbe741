"""Verdicts on URLs: rules first, logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of the character n-grams, and the features they are hashed to, for host and path each.
GRAMS = (3, 4)
FEATURES = 1 << 13
#: Most labelled URLs that the classifier is fitted on.
LABELLED_ROWS = 5_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to a slash, ``?``, ``#`` or the end, in lower case; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (as text), and its verdict; both null if none does.

    A rule fits its host and every subdomain of it, if the path starts with the rule's path. Of
    rules of equal length that both fit, the first given wins.
    """
    text = verdict = F.lit(None).cast("string")
    ranked = sorted(enumerate(rules), key=lambda x: (len(x[1].host + x[1].path), -x[0]))
    for _, rule in ranked:  # longer rules end up outermost
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.host + rule.path)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def grams(value: Column) -> Column:
    """All character n-grams of a value between marks for its start and end."""
    marked = F.concat(F.lit("^"), value, F.lit("$"))
    return F.flatten(F.array(*(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1))), lambda i, n=n: F.substring(marked, i, F.lit(n)))
        for n in GRAMS
    )))


def with_grams(urls: DataFrame) -> DataFrame:
    return urls.withColumn("host_grams", grams(F.col("host"))).withColumn("path_grams", grams(F.col("path")))


def labelled(urls: DataFrame, verdict: str, most: int = LABELLED_ROWS) -> DataFrame:
    """A small labelled table: distinct (host, path) with a verdict, at most ``most`` of them,
    chosen by hash so that reruns and any partitioning agree."""
    known = urls.where(F.col(verdict).isNotNull()).groupBy("host", "path").agg(F.min(verdict).alias("verdict"))
    return known.orderBy(F.xxhash64("host", "path"), "host", "path").limit(most)


def fit(table: DataFrame) -> PipelineModel | None:
    """A classifier from (host, path, verdict); None if ``table`` has no row.

    Both verdicts weigh the same in sum, however many rows each has.
    """
    table = with_grams(table).withColumn("label", (F.col("verdict") == "block").cast("double"))
    counts = {row["label"]: row["n"] for row in table.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if not counts:
        return None
    weights = F.create_map(*(F.lit(x) for label, n in counts.items() for x in (label, sum(counts.values()) / (len(counts) * n))))
    table = table.withColumn("weight", weights[F.col("label")])
    return Pipeline(stages=[
        HashingTF(inputCol="host_grams", outputCol="host_features", numFeatures=FEATURES),
        HashingTF(inputCol="path_grams", outputCol="path_features", numFeatures=FEATURES),
        VectorAssembler(inputCols=["host_features", "path_features"], outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=0.01, maxIter=25, standardization=False, aggregationDepth=2),
    ]).fit(table)


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", most: int = LABELLED_ROWS) -> DataFrame:
    """``pages`` with host, path, rule, block_score and verdict (allow or block).

    The longest fitting rule decides, else the classifier, which is fitted on at most ``most``
    of the distinct URLs that rules decide. block_score is its estimate for every URL. A null
    URL, and one without ``://``, has an empty host and path, which the classifier judges like any
    other. Without any labelled URL the score is null and the verdict allow. Repeated rows are
    judged each. Columns of these names already in ``pages`` are replaced.
    """
    parsed = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    text, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", text).withColumn("verdict", verdict)
    model = fit(labelled(parsed.select("host", "path", "verdict"), "verdict", most))
    if model is None:
        return parsed.withColumn("block_score", F.lit(None).cast("double")).fillna({"verdict": "allow"})
    kept = [name for name in parsed.columns]
    prefix = "url_filter__"  # the classifier's own columns must not clash with those of pages
    inner = parsed.select(F.struct(*kept).alias(f"{prefix}row"), "host", "path")
    scored = model.transform(with_grams(inner)).select(
        f"{prefix}row.*", vector_to_array(F.col("probability"))[1].alias(f"{prefix}score")
    )
    decided = F.coalesce("verdict", F.when(F.col(f"{prefix}score") > 0.5, "block").otherwise("allow"))
    return scored.withColumn("verdict", decided).withColumn("block_score", F.col(f"{prefix}score")).drop(f"{prefix}score")

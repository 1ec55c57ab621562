"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

DataFrame functions and Spark's own ``HashingTF`` and ``LogisticRegression`` only.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
A-Z lower-cased; the path goes on up to ``?`` or ``#``.  A rule (host, path) fits its
host and all subdomains where the url's path starts with the rule's; the longest
rule wins, of equally long ones the first in alphabetical order.

Urls without a rule are judged by the model: n-grams of 3 and 4 characters of host and
path, marked at their ends, hashed to ``SLOTS`` slots.  It is trained on a small table
of labelled urls, at most ``TRAIN_ROWS`` of each verdict in hash order.  Rules are a
parameter of bounded length; they become one CASE expression, so judging is a
single pass without a join.

Edge cases: a null url and one without ``://`` have an empty host and path, fit no
rule and get the model's verdict on empty features; an empty labelled table makes
the model allow everything, one with a single verdict repeats it; repeated rows are
judged alike; an empty table returns none.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import stage_table

SLOTS = 1 << 14
SIZES = (3, 4)
TRAIN_ROWS = 2000
MAX_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_case(rules: Sequence[Rule]) -> Column:
    """The longest fitting rule of columns ``host`` and ``path`` as a struct (rule, verdict), or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    case = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        case = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(case)
    return case


def _grams(text: Column, mark: str) -> Column:
    """Character n-grams of a text with its ends marked; texts shorter than an n-gram have one, themselves."""
    whole = F.concat(F.lit("^"), text, F.lit("$"))
    lists = [
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - (n - 1), F.lit(1))), _piece(whole, mark, n))
        for n in SIZES
    ]
    return F.concat(*lists)


def _piece(whole: Column, mark: str, size: int) -> Callable[[Column], Column]:
    return lambda i: F.concat(F.lit(mark), F.substring(whole, i, F.lit(size)))


def with_features(df: DataFrame) -> DataFrame:
    df = df.withColumn("_llm_grams", F.concat(_grams(F.col("host"), "h:"), _grams(F.col("path"), "p:")))
    return HashingTF(inputCol="_llm_grams", outputCol="_llm_features", numFeatures=SLOTS, binary=True).transform(df).drop("_llm_grams")


def train(labelled: DataFrame, url_col: str = "url", verdict_col: str = "verdict", rows: int = TRAIN_ROWS) -> Callable[[DataFrame], DataFrame]:
    """Fit on labelled urls; the result adds ``model_verdict`` to a table with ``host`` and ``path``."""
    urls = labelled.select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), (F.col(verdict_col) == "block").cast("double").alias("label"))
    urls = urls.dropna().distinct().withColumn("place", F.xxhash64("host", "path"))
    parts = [urls.filter(F.col("label") == k).orderBy("place", "host", "path").limit(rows) for k in (0.0, 1.0)]
    sample = stage_table(parts[0].unionByName(parts[1]), "urls")
    found = {r["label"] for r in sample.select("label").distinct().collect()}
    if len(found) < 2:
        return lambda df: df.withColumn("model_verdict", F.lit("block" if 1.0 in found else "allow"))
    fitted = LogisticRegression(featuresCol="_llm_features", predictionCol="_llm_block", probabilityCol="", rawPredictionCol="", maxIter=25, regParam=0.01).fit(
        with_features(sample.coalesce(1)).select("label", "_llm_features")
    )

    def judge(df: DataFrame) -> DataFrame:
        judged = fitted.transform(with_features(df))
        return judged.withColumn("model_verdict", F.when(F.col("_llm_block") == 1.0, "block").otherwise("allow")).drop("_llm_features", "_llm_block")

    return judge


def by_rules(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``url``, ``host``, ``path``, ``rule`` and the rule's ``verdict`` (null without one) of every page."""
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return parts.withColumn("found", rule_case(rules)).select("page_id", "url", "host", "path", "found.rule", "found.verdict")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule`` and ``verdict``; ``labelled`` holds (url, verdict)."""
    judged = train(labelled)(by_rules(pages, rules, id_col, url_col))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", "model_verdict").alias("verdict"))

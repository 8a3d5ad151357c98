"""URL filters (JVM-side only): path rules, and a logistic regression on hashed character n-grams of host and path.

The regression learns from a small table of labelled URLs; at most `max_labelled` of them, the ones with the
smallest hash. Where no table is given, it is the one of labelled_urls().

Defined results: a null URL and one without :// have an empty host and path, fit no rule, and get the
regression's verdict for no n-grams; if the labelled URLs are of one kind or none, the verdict beside the rules
is allow; rows that repeat a page_id are judged each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, checkpointed, table
from .labelled_urls import labelled_urls

#: The rules of the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class UrlParams:
    lengths: tuple[int, ...] = (3, 4)
    features: int = 1 << 14
    #: Labelled URLs to learn from, at most.
    max_labelled: int = 20_000
    regularisation: float = 0.001
    rounds: int = 40


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    text = F.coalesce(url, F.lit(""))
    rest = r"(?s)^.*?://"
    host = F.translate(F.regexp_extract(text, rest + r"([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(text, rest + r"[^/?#]*([^?#]*)", 1)


def with_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule (host and path of the longest fitting one) and ruled (its verdict) by column url."""
    host, path = parts(F.col("url"))
    out = urls.withColumns({"host": host, "path": path})
    longest_first = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [
        (((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), h + p, verdict) for verdict, h, p in longest_first
    ]
    return out.withColumns({
        "rule": F.coalesce(*[F.when(c, F.lit(rule)) for c, rule, _ in fits], F.lit(None).cast("string")),
        "ruled": F.coalesce(*[F.when(c, F.lit(v)) for c, _, v in fits], F.lit(None).cast("string")),
    })


def grams(host: Column, path: Column, lengths: tuple[int, ...]) -> Column:
    """The character n-grams of host and path, told apart, with an edge mark at either end."""

    def of(mark: str, text: Column, n: int) -> Column:
        edged = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.sequence(F.lit(1), F.char_length(edged) - n + 1)
        return F.when(F.char_length(edged) >= n, F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(edged, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(mark, text, n) for mark, text in (("h", host), ("p", path)) for n in lengths])


def judge(pages: DataFrame, rules=RULES, p: UrlParams = UrlParams(), labelled: DataFrame | None = None) -> DataFrame:
    """A row per row of pages: page_id, host, path, rule, verdict, score. labelled: (url, label), 1 for block."""
    ruled = with_rules(pages.select("page_id", "url"), rules)
    if labelled is None:
        labelled = labelled_urls(pages.sparkSession)
    small = labelled.where("url is not null").dropDuplicates(["url", "label"]).orderBy(F.xxhash64("url"), "url", "label").limit(p.max_labelled)
    host, path = parts(F.col("url"))
    tf = HashingTF(numFeatures=p.features, binary=True, inputCol="grams", outputCol="features")
    known = checkpointed(tf.transform(small.select(F.col("label").cast("double"), grams(host, path, p.lengths).alias("grams"))).select("label", "features"))
    kinds = known.agg(F.count_distinct("label").alias("n")).first()["n"]
    if kinds < 2:
        scored = ruled.withColumn("score", F.lit(0.0))
    else:
        model = LogisticRegression(maxIter=p.rounds, regParam=p.regularisation, standardization=False, aggregationDepth=2).fit(known)
        featured = tf.transform(ruled.withColumn("grams", grams(F.col("host"), F.col("path"), p.lengths)))
        scored = model.transform(featured).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    judged = F.coalesce("ruled", F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", judged.alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))

"""Typed tables in and out: metadata is what types a column, not its physical type."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Integer representations and the types that hold them.
REPRESENTATIONS = {"Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint", "UInt8": "smallint", "UInt16": "int", "UInt32": "bigint", "UInt64": "decimal(20,0)", "Float": "double"}
TRUE_TEXTS, FALSE_TEXTS = ("True", "true", "TRUE", "1", "1.0"), ("False", "false", "FALSE", "0", "0.0")
#: Date directives and Spark's letters for them.
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD"}


@dataclass(frozen=True)
class ColumnMeta:
    sdtype: str
    representation: str | None = None
    datetime_format: str | None = None

    @property
    def spark_type(self) -> str:
        if self.sdtype == "numerical":
            return REPRESENTATIONS[self.representation or "Float"]
        return {"boolean": "boolean", "datetime": "timestamp"}.get(self.sdtype, "string")


@dataclass(frozen=True)
class TableMeta:
    columns: Mapping[str, ColumnMeta]

    @classmethod
    def from_json(cls, text: str) -> TableMeta:
        return cls({n: ColumnMeta(c["sdtype"], c.get("computer_representation"), c.get("datetime_format")) for n, c in json.loads(text)["columns"].items()})

    def of(self, *sdtypes: str) -> list[str]:
        return [n for n, c in self.columns.items() if c.sdtype in sdtypes]


def spark_pattern(directives: str) -> str:
    """A date pattern of % directives in Spark's letters; plain letters are quoted."""
    out, i = "", 0
    while i < len(directives):
        if directives[i] == "%":
            if directives[i : i + 2] not in DIRECTIVES:
                raise ValueError(f"unsupported directive {directives[i : i + 2]}")
            out, i = out + DIRECTIVES[directives[i : i + 2]], i + 2
        else:
            out, i = out + (f"'{directives[i]}'" if directives[i].isalpha() else directives[i]), i + 1
    return out


def typed(name: str, meta: ColumnMeta) -> Column:
    """The column as its metadata says; what doesn't parse is NULL, and so is NaN."""
    raw = F.col(f"`{name}`")
    text = raw.cast("string")
    if meta.sdtype == "boolean":
        return F.when(text.isin(*TRUE_TEXTS), True).when(text.isin(*FALSE_TEXTS), False).alias(name)
    if meta.sdtype == "datetime":
        value = F.try_to_timestamp(text, F.lit(spark_pattern(meta.datetime_format))) if meta.datetime_format else text.try_cast("timestamp")
        return value.alias(name)
    if meta.sdtype == "numerical":
        kind = meta.spark_type
        number = F.when(~F.isnan(text.try_cast("double")), text.try_cast("double"))
        if kind == "double":
            return number.alias(name)
        exact = F.coalesce(text.try_cast("decimal(38,0)"), F.bround(number, 0).try_cast("decimal(38,0)"))
        low = F.when(exact >= 0, exact) if (meta.representation or "").startswith("UInt") else exact
        top = {"UInt8": 255, "UInt16": 65535, "UInt32": 4294967295}.get(meta.representation or "")
        return (F.when(low <= top, low) if top else low).try_cast(kind).alias(name)
    return text.alias(name)


def apply_meta(df: DataFrame, meta: TableMeta) -> DataFrame:
    """The described columns, typed, with sdtype in their field metadata."""
    return df.select(*[typed(n, c).alias(n, metadata={"sdtype": c.sdtype}) for n, c in meta.columns.items()])


def read_table(spark: SparkSession, path: str, meta: TableMeta, fmt: str = "parquet") -> DataFrame:
    """CSV is read as text and then typed; nothing is inferred."""
    if fmt == "csv":
        header = spark.read.option("header", True).csv(path).limit(0).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        return apply_meta(spark.read.schema(schema).option("header", True).csv(path), meta)
    return apply_meta(spark.read.format(fmt).load(path), meta)


def infer_meta(df: DataFrame, few: int = 20) -> DataFrame:
    """(column, sdtype): by type; whole numbers with few values are categorical; *_id, *key of other whole numbers are ids. One pass."""
    counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in df.columns])

    def kind(c: str, t: str) -> Column:
        if t in ("string", "boolean") or t.startswith("array"):
            return F.lit({"boolean": "boolean"}.get(t, "categorical"))
        if t in ("date", "timestamp", "timestamp_ntz"):
            return F.lit("datetime")
        if t in ("tinyint", "smallint", "int", "bigint"):
            return F.when(F.lit(c.lower().endswith(("id", "key"))), "id").when(F.col(c) <= few, "categorical").otherwise("numerical")
        return F.lit("numerical")

    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), kind(c, t).alias("sdtype")) for c, t in df.dtypes])))


def meta_summary(df: DataFrame) -> DataFrame:
    """(column, dtype, sdtype, nulls, samples): three of its smallest values as samples."""
    kinds = {f.name: (f.dataType.simpleString(), f.metadata.get("sdtype")) for f in df.schema.fields}
    texts = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("dtype"), F.lit(s).cast("string").alias("sdtype"), F.col(c).cast("string").alias("value")) for c, (k, s) in kinds.items()])
    counts = df.select(F.inline(texts)).groupBy("column", "dtype", "sdtype", "value").agg(F.count("*").alias("n"))
    ranked = counts.groupBy("column", "dtype", "sdtype").agg(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.min("value").alias("first"), F.max("value").alias("last"), F.max_by("value", "n").alias("commonest"))
    return ranked.select("column", "dtype", "sdtype", "nulls", F.array_distinct(F.array("first", "commonest", "last")).alias("samples"))


def read_metric_tables(spark: SparkSession, paths: str | Sequence[str], required: Sequence[str] = ("generation",)) -> DataFrame:
    """All runs' metric CSVs as one table, with dseed and mseed from the folder names; missing columns are an error."""
    df = spark.read.option("header", True).csv(paths)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"metric tables lack {', '.join(missing)}")
    name, run = F.input_file_name(), r"_dseed(\d+)_.*_mseed(\d+)"
    out = df.withColumns({n: F.regexp_extract(name, run, i + 1).try_cast("int") for i, n in enumerate(("dseed", "mseed"))})
    return out.withColumn("generation", F.col("generation").cast("int"))


#: Metric, where its number stands in a run's JSON, and where its status stands (None: it has none). The files' layouts differ by kind of metric.
METRIC_PATHS = (
    ("alpha_delta_precision_OC", "metrics.alpha_precision.scores.delta_precision_alpha_OC", "metrics.alpha_precision.status"),
    ("alpha_delta_coverage_OC", "metrics.alpha_precision.scores.delta_coverage_beta_OC", "metrics.alpha_precision.status"),
    ("alpha_authenticity_OC", "metrics.alpha_precision.scores.authenticity_OC", "metrics.alpha_precision.status"),
    ("alpha_delta_precision_naive", "metrics.alpha_precision.scores.delta_precision_alpha_naive", "metrics.alpha_precision.status"),
    ("alpha_delta_coverage_naive", "metrics.alpha_precision.scores.delta_coverage_beta_naive", "metrics.alpha_precision.status"),
    ("alpha_authenticity_naive", "metrics.alpha_precision.scores.authenticity_naive", "metrics.alpha_precision.status"),
    ("prdc_precision", "metrics.prdc_score.precision", "metrics.prdc_score.status"),
    ("prdc_recall", "metrics.prdc_score.recall", "metrics.prdc_score.status"),
    ("prdc_density", "metrics.prdc_score.density", "metrics.prdc_score.status"),
    ("prdc_coverage", "metrics.prdc_score.coverage", "metrics.prdc_score.status"),
    ("wasserstein_dist", "metrics.wasserstein_distance.joint_distance", "metrics.wasserstein_distance.status"),
    ("mmd", "metrics.maximum_mean_discrepancy.joint_distance", "metrics.maximum_mean_discrepancy.status"),
    ("jsd_synthcity", "metrics.jensenshannon_synthcity.distance_score", "metrics.jensenshannon_synthcity.status"),
    ("jsd_syndat", "metrics.jensenshannon_syndat.distance_score", "metrics.jensenshannon_syndat.status"),
    ("jsd_nannyml", "metrics.jensenshannon_nannyml.distance_score", "metrics.jensenshannon_nannyml.status"),
    ("tv_complement", "metrics.tv_complement.aggregate_score", "metrics.tv_complement.status"),
    ("ks_complement", "metrics.ks_complement.aggregate_score", "metrics.ks_complement.status"),
    ("new_row_synthesis", "metrics.new_row_synthesis.score", "metrics.new_row_synthesis.status"),
    ("sdmetrics_column_shapes", "metrics.sdmetrics_quality.property_scores.column_shapes", "metrics.sdmetrics_quality.status"),
    ("sdmetrics_column_pair_trends", "metrics.sdmetrics_quality.property_scores.column_pair_trends", "metrics.sdmetrics_quality.status"),
    ("sdmetrics_overall", "metrics.sdmetrics_quality.score", "metrics.sdmetrics_quality.status"),
    ("k_anonymity_reference", "metrics.k_anonymization.k_values.reference.k", "metrics.k_anonymization.status"),
    ("k_anonymity_synthetic", "metrics.k_anonymization.k_values.synthetic.k", "metrics.k_anonymization.status"),
    ("k_ratio_synthetic_reference", "metrics.k_anonymization.k_ratios['Synthetic / Reference'].ratio", "metrics.k_anonymization.status"),
    ("complexity_population", "complexity_metrics.population.total_complexity", None),
    ("complexity_training", "complexity_metrics.training.total_complexity", None),
    ("complexity_reference", "complexity_metrics.reference.total_complexity", None),
    ("complexity_synthetic", "complexity_metrics.synthetic.total_complexity", None),
    ("complexity_ratio_vs_population", "complexity_metrics.comparisons.synthetic_vs_population_ratio", None),
    ("complexity_ratio_vs_training", "complexity_metrics.comparisons.synthetic_vs_training_ratio", None),
    ("complexity_ratio_vs_reference", "complexity_metrics.comparisons.synthetic_vs_reference_ratio", None),
    ("training_time", "training_time", None),
)
#: Numbers that stand as percentages.
PERCENT_PATHS = (
    ("factual_total", "quality_matrix_2x2.total_factual.rate_pct"),
    ("ddr_novel_factual", "quality_matrix_2x2.novel_factual.rate_pct"),
    ("plausible_total", "quality_matrix_2x2.total_plausible.rate_pct"),
    ("plausible_novel", "quality_matrix_2x2.novel_plausible.rate_pct"),
    ("category_ddr", "ddr_metrics.unique.rate_pct"),
    ("category_train_copy_valid", "training_copy_valid_metrics.unique.rate_pct"),
    ("category_train_copy_prop", "training_copy_propagation_metrics.unique.rate_pct"),
    ("category_new_halluc", "new_hallucination_metrics.unique.rate_pct"),
)
DETECTOR = "map<string, struct<status: string, auc_score: double>>"


def read_metric_json(spark: SparkSession, path: str | Sequence[str], id_path: str = "model_id") -> DataFrame:
    """(model_id, metric, value): the successful metrics of nested JSON files, one document a file, whatever their kind.

    Averages follow from their parts: prdc_avg, and detection_avg over the detectors, each of which is a metric of its own name.
    """
    docs = spark.read.option("wholetext", True).text([path] if isinstance(path, str) else [*path])
    at = lambda p: F.get_json_object("value", f"$.{p}")
    good = lambda p: F.lit(True) if p is None else F.coalesce(at(p) == "success", F.lit(False))
    plain = [F.struct(F.lit(n).alias("metric"), F.when(good(status), at(p).try_cast("double")).alias("value")) for n, p, status in METRIC_PATHS]
    percent = [F.struct(F.lit(n).alias("metric"), (at(p).try_cast("double") / 100).alias("value")) for n, p in PERCENT_PATHS]
    detectors = F.map_entries(F.from_json(at("individual_scores"), DETECTOR))
    worked = F.filter(F.coalesce(detectors, F.array().cast("array<struct<key: string, value: struct<status: string, auc_score: double>>>")), lambda d: d["value"]["status"] == "success")
    found = F.concat(F.array(*plain, *percent), F.transform(worked, lambda d: F.struct(d["key"].alias("metric"), d["value"]["auc_score"].alias("value"))))
    mean = F.try_divide(F.aggregate(worked, F.lit(0.0), lambda x, d: x + d["value"]["auc_score"]), F.size(worked))
    prdc = sum((F.coalesce(at(f"metrics.prdc_score.{n}").try_cast("double"), F.lit(0.0)) for n in ("precision", "recall", "density", "coverage")), F.lit(0.0)) / 4
    averages = F.array(F.struct(F.lit("detection_avg").alias("metric"), mean.alias("value")), F.struct(F.lit("prdc_avg").alias("metric"), F.when(good("metrics.prdc_score.status"), prdc).alias("value")))
    return docs.select(at(id_path).alias("model_id"), F.inline(F.concat(found, averages))).where("value is not null")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = False) -> None:
    """Refuses to write over what is there, unless told to."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).format(fmt).save(path)


def merge_metrics(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows in place of existing ones with the same keys."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def write_metrics(new: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Merges into the table at path. Each write is a version of its own, so the one being read is never overwritten."""
    spark = new.sparkSession
    try:
        last = spark.read.parquet(path).agg(F.max("version").alias("v")).first()["v"]
        merged = merge_metrics(spark.read.parquet(f"{path}/version={last}"), new, keys)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last, merged = -1, new
    merged.write.mode("errorifexists").parquet(f"{path}/version={last + 1}")


def skip_existing(plan: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The planned work that isn't done."""
    return plan.join(done.select(*keys).distinct(), list(keys), "left_anti")


def export_binned(tables: Mapping[str, DataFrame], population: DataFrame, columns: Sequence[str], n: int = 20) -> DataFrame:
    """All tables with their numbers cut into the population's bins, told apart by role: ready for write_table()."""
    from ..operators.membership import bin_numeric, numeric_ranges

    ranges, out = numeric_ranges(population, columns), None
    for role, df in tables.items():
        part = bin_numeric(df, ranges, columns, n).withColumn("role", F.lit(role))
        out = part if out is None else out.unionByName(part)
    return out

"""Secret scans (JVM-side only): base patterns, and multipart credential linking on top.

Weak parts - access identifiers, secrets and endpoints that would be noise alone - are interval-joined within
scopes: a part counts only if complementary parts start within the scope's distance of it, on either side. A
secret needs an identifier; an identifier or an endpoint needs a secret. Base spans are always reported
and serve as parts as well.

Parts of a document meet by scope cells (their place divided by the scope's length, and the neighbouring
cells), in a semi-join: a part is reported once however many partners it has.

Defined results: null and empty texts have no spans; rows that repeat a doc_id are scanned each by their own text;
extra columns are ignored, or kept by redact(). Places are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, let, row_key, table

#: Base kinds in their order, with pattern, least length and the group whose length counts.
BASE = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]+", 24, 0),
)
#: Parts that are reported only beside complementary ones: kind, role, pattern, least length, group.
WEAK = (
    ("identifier", "id", r"((?i:access_?key_?id|client_?id|account_?id|user_?name|login))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@_.-]+)", 3, 2),
    ("secret_part", "secret", r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 40, 0),
    ("endpoint", "endpoint", r"((?i:endpoint|host|server|url|jdbc))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9:/_.-]+)|[a-z]+://[A-Za-z0-9_.-]+(?::[0-9]+)?", 6, 0),
)
#: What the base kinds stand for.
BASE_ROLE = {"assign": "secret", "access": "id", "hex": "secret"}
KINDS = (*(k for k, *_ in BASE), *(k for k, *_ in WEAK))


@dataclass(frozen=True)
class SecretParams:
    #: Code points between the starts of complementary parts, at most.
    scope: int = 200
    mask: str = "[REDACTED]"


def pattern_spans(text: Column, kind: int, pattern: str, least: int, group: int) -> Column:
    """Array of (start, kind, end): leftmost non-overlapping matches whose group is long enough.

    The text between matches and the matches themselves add up to their places.
    """

    def folded(found: Column) -> Column:
        state = F.aggregate(
            F.arrays_zip(found["gap"], found["whole"], found["part"]),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("spans")),
            lambda acc, m: _step(acc, m),
        )
        return state["spans"]

    def _step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.char_length(m["gap"])
        end = start + F.char_length(m["whole"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.char_length(m["part"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    found = F.struct(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    # Most texts hold nothing that is long enough; hex digits alone are in all of them.
    worth = text.rlike(r"[0-9a-f]{24}") if pattern == r"[0-9a-f]+" else text.rlike(pattern)
    return F.when(worth, let(found, folded)).otherwise(nothing)


def _kind_column(kinds: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*[F.lit(k) for k in kinds]), number)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_digest, base and weak: arrays of (start, kind, end), kind as a number in KINDS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*row_key(), text.alias("text"))
    base = [pattern_spans(F.col("text"), i, pattern, least, group) for i, (_, pattern, least, group) in enumerate(BASE)]
    weak = [pattern_spans(F.col("text"), len(BASE) + i, pattern, least, group) for i, (_, _, pattern, least, group) in enumerate(WEAK)]
    return rows.select("doc_id", "text_digest", F.sort_array(F.concat(*base)).alias("base"), F.sort_array(F.concat(*weak)).alias("weak"))


def linked_parts(found: DataFrame, p: SecretParams) -> DataFrame:
    """doc_id, text_digest, linked: the weak parts of candidates() rows that have complementary parts in scope."""
    roles = [*(BASE_ROLE[k] for k, *_ in BASE), *(role for _, role, *_ in WEAK)]
    both = found.where(F.size("weak") > 0).where(F.size("base") + F.size("weak") > 1)
    parts = both.distinct().select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id_text"), "doc_id", "text_digest", F.explode(F.concat("base", "weak")).alias("span")
    ).withColumn("role", _kind_column(tuple(roles), F.col("span.kind")))
    cell = F.floor(F.col("span.start") / p.scope)
    asking = parts.where(F.col("span.kind") >= len(BASE)).withColumn("cell", cell)
    offered = parts.select(
        F.col("id_text").alias("o_id"), F.col("text_digest").alias("o_digest"), F.col("span.start").alias("o_start"), F.col("role").alias("o_role"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("o_cell")
    )
    complementary = ((F.col("role") == "secret") & (F.col("o_role") == "id")) | ((F.col("role") != "secret") & (F.col("o_role") == "secret"))
    met = asking.join(
        offered,
        (F.col("id_text") == F.col("o_id"))
        & (F.col("text_digest") == F.col("o_digest"))
        & (F.col("cell") == F.col("o_cell"))
        & (F.abs(F.col("span.start") - F.col("o_start")) <= p.scope)
        & complementary,
        "left_semi",
    )
    return met.groupBy("id_text", "text_digest").agg(F.sort_array(F.collect_list("span")).alias("linked"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _kind_column(KINDS, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, p: SecretParams = SecretParams()) -> DataFrame:
    """A row per row of docs: doc_id, text_digest, base, spans (base and linked weak ones), as arrays of (start, kind, end)."""
    found = checkpointed(candidates(docs))
    linked = linked_parts(found, p).withColumnsRenamed({"id_text": "l_id", "text_digest": "l_digest"})
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    joined = found.join(linked, (id_text == F.col("l_id")) & (F.col("text_digest") == F.col("l_digest")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return joined.select("doc_id", "text_digest", "base", F.sort_array(F.concat("base", F.coalesce("linked", none))).alias("spans"))


def redact(docs: DataFrame, p: SecretParams = SecretParams()) -> DataFrame:
    """docs with each span (overlapping ones as one) replaced by the mask. Columns as they are (n_chars, if there, renewed)."""
    found = scan(docs, p).where(F.size("spans") > 0).distinct()
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_digest").alias("__digest"), F.col("spans").alias("__spans"))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__digest")), "left")

    def step(acc: Column, s: Column) -> Column:
        # at: the end of what has been copied or masked so far.
        before = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        apart = (s["start"] > acc["at"]) | (acc["out"] == "")
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(acc["out"], before, F.lit(p.mask))).otherwise(acc["out"]).alias("out"),
        )

    state = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    masked = let(state, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.char_length("text"))))
    out = joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(masked))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _of_kind(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    counts = [_of_kind(i).cast("long").alias(f"n_{kind}") for i, (kind, *_) in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))

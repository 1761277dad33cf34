"""Batch accept, the client-side preview of it, and re-scoring of overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.functions.scores import combined_score, text_precision
from clausework.functions.text import normalize_text, trimmed
from clausework.functions.vectors import cosine_similarity
from clausework.operators.ledger import etag_status, lookup_versions
from clausework.operators.scan import ROWS_PER_TASK, lookup
from clausework.schemas import ACCEPT_THRESHOLD

VERSION_KEY = ["contract_id", "version_number"]


def acceptable(override: Column, score: Column) -> Column:
    """No override at all ('' is one) and a score at the threshold; a missing score fails."""
    return override.isNull() & (F.coalesce(score, F.lit(-1.0)) >= ACCEPT_THRESHOLD)


def preview_acceptable(override: Column) -> Column:
    """What the review screen marks: any blank override, whatever the score."""
    return trimmed(F.coalesce(override, F.lit(""))) == ""


def accept(parameters: DataFrame, predicate: Column) -> DataFrame:
    """Copy the original over the override and set the score to 1.0 where ``predicate`` holds."""
    return parameters.withColumn("_hit", predicate).withColumns({
        "user_override": F.when(F.col("_hit"), F.col("original_extract")).otherwise(F.col("user_override")),
        "combined_score": F.when(F.col("_hit"), F.lit(1.0)).otherwise(F.col("combined_score")),
    }).drop("_hit")


def batch_accept(parameters: DataFrame) -> DataFrame:
    """Accept over all contracts: a row-local projection, no shuffle."""
    return accept(parameters, acceptable(F.col("user_override"), F.col("combined_score")))


def accept_preview(parameters: DataFrame) -> DataFrame:
    return accept(parameters, preview_acceptable(F.col("user_override")))


def accept_counts(parameters: DataFrame, keys: list[str]) -> DataFrame:
    """Rows a batch accept updates, per version."""
    return (
        parameters.filter(acceptable(F.col("user_override"), F.col("combined_score")))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("updated"))
    )


def _accepted_once_and_again(parameters: DataFrame) -> DataFrame:
    """Per version: rows a first accept updates, and those a further one does, as nothing filled their override."""
    hits = parameters.filter(acceptable(F.col("user_override"), F.col("combined_score")))
    return hits.groupBy(*VERSION_KEY).agg(
        F.count(F.lit(1)).alias("_once"), F.count_if(F.col("original_extract").isNull()).alias("_again")
    )


def accept_requests(
    requests: DataFrame, versions: DataFrame, parameters: DataFrame, order: str = "seq", rows_per_task: int = ROWS_PER_TASK
):
    """Batch accept for (contract_id, version_number, if_match) requests, in the unique ``order``.

    Of several granted requests for a version the first does the work. Returns (requests with status and updated count, parameter table afterwards).
    """
    looked_up = lookup_versions(requests, versions.select(*VERSION_KEY, "etag"), rows_per_task=rows_per_task)
    status = F.when(F.col("status") == 404, F.lit(404)).otherwise(
        etag_status(F.col("if_match"), F.col("etag"))
    )
    judged = looked_up.withColumn("status", status)
    granted = judged.filter("status = 200").groupBy(*VERSION_KEY).agg(F.min(order).alias("_first"))
    # Counted per version before the join; only accepted rows are ever updated.
    counts = granted.join(_accepted_once_and_again(parameters), VERSION_KEY, "left")
    updated = F.when(F.col(order) == F.col("_first"), F.col("_once")).otherwise(F.col("_again"))
    replies = lookup(judged, counts, VERSION_KEY, "left", rows_per_task).withColumn(
        "updated", F.when(F.col("status") == 200, F.coalesce(updated, F.lit(0)))
    ).drop("etag", "_first", "_once", "_again")
    marked = lookup(parameters, granted.select(*VERSION_KEY, F.lit(True).alias("_granted")), VERSION_KEY, "left", rows_per_task)
    after = accept(
        marked,
        F.col("_granted").isNotNull() & acceptable(F.col("user_override"), F.col("combined_score")),
    ).select(*parameters.columns)
    return replies, after


def accept_divergence(parameters: DataFrame) -> DataFrame:
    """Rows that the server's accept and the preview leave different, compared in one pass."""
    server = acceptable(F.col("user_override"), F.col("combined_score"))
    preview = preview_acceptable(F.col("user_override"))
    both = parameters.withColumns({"_server": server, "_preview": preview})

    def after(hit):
        return (
            F.when(F.col(hit), F.col("original_extract")).otherwise(F.col("user_override")),
            F.when(F.col(hit), F.lit(1.0)).otherwise(F.col("combined_score")),
        )

    (s_override, s_score), (p_override, p_score) = after("_server"), after("_preview")
    return both.select(
        *parameters.columns,
        F.col("_server").alias("server_accepts"),
        F.col("_preview").alias("preview_accepts"),
        s_override.alias("server_override"),
        s_score.alias("server_score"),
        p_override.alias("preview_override"),
        p_score.alias("preview_score"),
    ).filter(
        ~F.col("server_override").eqNullSafe(F.col("preview_override"))
        | ~F.col("server_score").eqNullSafe(F.col("preview_score"))
    )


def latest_overrides(overrides: DataFrame) -> DataFrame:
    """The last override of each parameter by ``seq``, combined map-side."""
    others = [c for c in overrides.columns if c not in ("parameter_id", "seq")]
    return overrides.groupBy("parameter_id").agg(
        F.max_by(F.struct(*others), "seq").alias("_last")
    ).select("parameter_id", "_last.*")


def score_overrides(overrides: DataFrame, parameters: DataFrame, embedder=None) -> DataFrame:
    """Latest override per parameter with ``status`` (200 or 404) and its new ``combined_score``.

    Text: ratio of the normalised texts. Meaning: cosine of the stored vector and the vector of
    the raw override, 0.0 when either is missing or the override is empty. ``embedder`` maps a
    DataFrame with ``user_override`` to one with ``override_embed``; None if it is there already.
    """
    latest = latest_overrides(overrides)
    stored = parameters.select("parameter_id", "original_extract", "vector_embed")
    # Inner join: the small batch of overrides may be broadcast, or filter the scan at run time.
    # Only overridden rows meet the Python ratio; the rest of the table never leaves the JVM.
    pairs = latest.join(stored, "parameter_id")
    if embedder is not None:
        pairs = embedder(pairs)
    pairs = normalize_text(pairs, "original_extract", "_original")
    pairs = normalize_text(pairs, "user_override", "_override")
    semantic = F.when(
        F.col("vector_embed").isNotNull() & (F.coalesce(F.col("user_override"), F.lit("")) != ""),
        cosine_similarity(F.col("vector_embed"), F.col("override_embed")),
    ).otherwise(F.lit(0.0))
    score = combined_score(text_precision(F.col("_original"), F.col("_override")), semantic)
    known = parameters.select("parameter_id").join(latest.select("parameter_id"), "parameter_id", "left_semi")
    unknown = latest.join(known, "parameter_id", "left_anti")
    return pairs.select(
        "parameter_id", "user_override", F.lit(200).alias("status"), score.alias("combined_score")
    ).unionByName(unknown.select(
        "parameter_id", "user_override", F.lit(404).alias("status"), F.lit(None).cast("double").alias("combined_score")
    ))


def apply_overrides(parameters: DataFrame, scored: DataFrame) -> DataFrame:
    """The parameter table after the scored overrides; stored vectors stay as they are."""
    new = scored.filter("status = 200").select(
        "parameter_id", F.struct("user_override", "combined_score").alias("_new")
    )
    return parameters.join(new, "parameter_id", "left").select(*[
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
        if c in ("user_override", "combined_score")
        else F.col(c)
        for c in parameters.columns
    ])

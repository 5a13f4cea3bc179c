"""How well the evidence supports a conclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Weights of the contours and bounds of the verdicts.
WEIGHTS = {"logs": 0.30, "kb": 0.30, "code": 0.25, "trace": 0.15}
CONFIRMED, LIKELY = 0.70, 0.40


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def logs_contour(signatures: Column, top_errors: Column, buckets: Column, peak: Column, mean: Column) -> Column:
    """0.4 for signatures; 0.3 for an error seen three times, 0.15 for fewer; 0.3 for a peak of 5 and three times the mean, 0.1 for a flat histogram of three buckets."""
    return clamp(F.when(signatures > 0, 0.4).otherwise(0.0) + F.when(top_errors >= 3, 0.3).when(top_errors > 0, 0.15).otherwise(0.0)
                 + F.when(buckets >= 3, F.when(peak >= F.greatest(F.lit(5.0), mean * 3), 0.3).otherwise(0.1)).otherwise(0.0))


def kb_contour(score: Column, outcome: Column, stand_fits: Column, service_fits: Column) -> Column:
    """Score from 3 to 20 as 0 to 1; 0 if the entry is refuted; times 0.6 each if unverified, of another stand, of another service."""
    v = clamp((score - 3) / 17)
    v = F.when(outcome == "refuted", 0.0).when(outcome == "confirmed", v).otherwise(v * 0.6)
    return v * F.when(F.coalesce(stand_fits, F.lit(True)), 1.0).otherwise(0.6) * F.when(F.coalesce(service_fits, F.lit(True)), 1.0).otherwise(0.6)


def code_contour(resolved: Column, phrase_hits: Column, linked: Column, commits: Column) -> Column:
    """0.5 for a frame found in the repository, 0.2 for a phrase, 0.3 for a commit that touched it or 0.05 for any in the window."""
    return clamp(F.when(resolved > 0, 0.5).otherwise(0.0) + F.when(phrase_hits > 0, 0.2).otherwise(0.0) + F.when(linked > 0, 0.3).when(commits > 0, 0.05).otherwise(0.0))


def trace_contour(hops: Column, has_break: Column) -> Column:
    """0.5 for two hops, 0.5 for a first error."""
    return F.when(hops >= 2, 0.5).otherwise(0.0) + F.when(has_break, 0.5).otherwise(0.0)


def verdict(total: Column) -> Column:
    return F.when(total >= CONFIRMED, "confirmed_by_data").when(total >= LIKELY, "likely_cause").when(total > 0, "hypothesis").otherwise("insufficient_data")


def combine(evidence: DataFrame) -> DataFrame:
    """Add total and verdict to rows with columns logs, kb, code, trace in 0..1; a null contour adds nothing and its weight is not passed on."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    df = evidence.withColumn("total", F.round(total, 4))
    return df.withColumn("verdict", verdict(F.col("total")))


def evidence_from_logs(signatures: DataFrame, groups: DataFrame, histogram: DataFrame) -> DataFrame:
    """One row `logs`, from three aggregated tables."""
    s = signatures.agg(F.count(F.lit(1)).alias("s"))
    g = groups.where(F.col("level_rank") >= 6).agg(F.coalesce(F.max("count"), F.lit(0)).alias("g"))
    h = histogram.agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("p"), F.avg("count").alias("m"))
    return s.crossJoin(g).crossJoin(h).select(logs_contour(F.col("s"), F.col("g"), F.col("n"), F.col("p").cast("double"), F.col("m")).alias("logs"))  # one row each

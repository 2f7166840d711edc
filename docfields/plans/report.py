"""Batch quality report: rates and mismatch counts instead of per-document log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counted measures and the rate of each among the records.
RATES = {
    "no_issue_date": "no_issue_share", "weak_zone": "weak_zone_share", "unread_zone": "unread_zone_share", "is_valid": "valid_share",
}


def facts(records: DataFrame) -> DataFrame:
    """What the report counts of each record: kind, captured_at and the measures. Narrow; no personal data."""
    has = lambda c: nullif_blank(f"mrz_fields.{c}").isNotNull()
    # what the check of a kind cannot do without
    weak = ~(has("card_number") & F.when(F.col("kind") == "id", has("personal_id")).otherwise(has("birth_date")))
    return records.select(
        "kind",
        "captured_at",
        (F.col("issue_date") == "").alias("no_issue_date"),
        weak.alias("weak_zone"),
        # the zone is in the photo, its numbers could not be read
        (weak & F.col("prefix_seen")).alias("unread_zone"),
        "is_valid",
        F.size("verification.mismatches").cast("long").alias("mismatches"),
    )


def measures() -> list[Column]:
    """Counts of the report, as aggregates with partial results."""
    return [
        F.count(F.lit(1)).alias("records"),
        *[F.count_if(F.col(c)).alias(c) for c in RATES],
        F.sum("mismatches").alias("mismatches"),
    ]


def with_rates(report: DataFrame) -> DataFrame:
    """Shares of the records beside the counts."""
    return report.withColumns({share: F.col(c) / F.col("records") for c, share in RATES.items()})


def quality_report(records: DataFrame) -> DataFrame:
    """Counts and rates per kind and day with subtotals. No personal data leaves the aggregation."""
    daily = facts(records).withColumn("day", F.to_date("captured_at"))
    return with_rates(daily.rollup("kind", "day").agg(*measures()))


def nullif_blank(column: str):
    return F.nullif(F.col(column), F.lit(""))


def mismatch_report(records: DataFrame) -> DataFrame:
    """Failed checks per kind and field."""
    failed = records.select("kind", F.explode("verification.mismatches").alias("field"))
    return failed.groupBy("kind", "field").agg(F.count(F.lit(1)).alias("records"))

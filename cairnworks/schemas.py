"""Schemas of the tables, their enumerations and ranges, and the rows that break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnworks.operators.classify import ACCESS, BUCKETS, CATEGORIES
from cairnworks.operators.state import RUN

OFFERS = (
    "url string, source string, source_specific string, reference string, title string, contract_type string, duration string, education_level string, experience_level string, location string, lab string, "
    "published_at_text string, description string, skills string, raw_text string, unavailable boolean, hard_filter_passed boolean, is_target boolean, target_bucket string, accessibility string, exclusion_reason string, "
    "short_summary string, why_interesting string, risk_flags array<string>, classifier_version string, content_hash string, last_classified_at timestamp, ai_relevance_score double, ai_category string, ai_reason string, "
    "first_seen_at timestamp, last_seen_at timestamp, last_seen_status string"
)
SNAPSHOTS = "id long, offer_url string, reference string, content_hash string, fetched_at timestamp, raw_path string, run_id long"
CACHE = "content_hash string, classifier_version string, response_json string, created_at timestamp"
RAW_PAGES = "url string, payload string, fetched_at timestamp"
RUNS = RUN
STATUSES = ("seen", "missing", "unavailable")

# rule name -> whether a row keeps it; null enumerations are allowed unless the column is required
OFFER_RULES: dict[str, str] = {
    **{f"{c} missing": f"{c} IS NOT NULL AND {c} <> ''" for c in ("url", "source", "title")},
    "raw_text missing": "raw_text IS NOT NULL",
    **{f"{c} unknown": f"{c} IS NULL OR {c} IN ({', '.join(repr(v) for v in values)})" for c, values in (("target_bucket", BUCKETS), ("accessibility", ACCESS), ("ai_category", CATEGORIES), ("last_seen_status", STATUSES))},
    "score out of range": "ai_relevance_score IS NULL OR ai_relevance_score BETWEEN 0 AND 1",
    "seen backwards": "first_seen_at IS NULL OR last_seen_at IS NULL OR first_seen_at <= last_seen_at",
}


def broken_rules(rules: dict[str, str] = OFFER_RULES) -> Column:
    """The names of the rules that a row breaks, in order."""
    return F.filter(F.array(*[F.when(~F.coalesce(F.expr(e), F.lit(False)), F.lit(name)) for name, e in rules.items()]), lambda x: x.isNotNull())


def quarantined(df: DataFrame, rules: dict[str, str] = OFFER_RULES) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, the others with a column `broken`)."""
    marked = df.withColumn("broken", broken_rules(rules))
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)

"""Queries over the delivered snapshots: changes between deliveries and attribute history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnworks.operators.history import offer_history
from cairnworks.operators.snapshot_diff import offer_changes
from cairnworks.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offer_changes(table(spark, sf_dir, "offer_snapshots"), table(spark, sf_dir, "runs"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offer_history(table(spark, sf_dir, "offer_snapshots"), table(spark, sf_dir, "offers"))


def p1_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest change of every offer beside what its last_seen_status claims."""
    order = table(spark, sf_dir, "runs").select(F.col("id").alias("run_id"), "started_at")
    last = p1_found(spark, sf_dir).join(order, "run_id").groupBy("offer_url").agg(F.max(F.struct("started_at", "run_id", "change_type")).alias("x"))
    known = table(spark, sf_dir, "offers").select(F.col("url").alias("offer_url"), "last_seen_status")
    gone = F.col("last_seen_status").isin("missing", "unavailable")
    return last.join(known, "offer_url").select("offer_url", "x.run_id", "x.change_type", "last_seen_status", ((F.col("x.change_type") == "removed") == gone).alias("agrees"))


def p3_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of every offer and how many it has had."""
    versions = p3_found(spark, sf_dir)
    return versions.groupBy("offer_url").agg(F.max("version_no").alias("versions"), F.max("valid_from_us").alias("valid_from_us"), F.count_if(F.col("valid_to_us") == -1).alias("open_versions"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p1_claims": p1_claims, "p3_current": p3_current}

_SQL = {
    "p1_found": r"""
WITH ok AS (
  SELECT id, lag(id) OVER (PARTITION BY source ORDER BY started_at, id) AS before
  FROM runs WHERE finished_at IS NOT NULL AND lower(trim(status_message)) = 'ok'),
latest AS (
  SELECT run_id, offer_url, regexp_replace(lower(trim(content_hash)), '^sha256:', '') AS h
  FROM offer_snapshots WHERE run_id IN (SELECT id FROM ok)
  QUALIFY row_number() OVER (PARTITION BY run_id, offer_url ORDER BY fetched_at DESC, id DESC) = 1),
cur AS (SELECT ok.id AS pair, l.offer_url, l.h FROM ok JOIN latest l ON l.run_id = ok.id WHERE ok.before IS NOT NULL),
prev AS (SELECT ok.id AS pair, l.offer_url, l.h FROM ok JOIN latest l ON l.run_id = ok.before)
SELECT coalesce(c.pair, p.pair) AS run_id, coalesce(c.offer_url, p.offer_url) AS offer_url,
  CASE WHEN p.pair IS NULL THEN 'added' WHEN c.pair IS NULL THEN 'removed' ELSE 'changed' END AS change_type
FROM cur c FULL JOIN prev p ON c.pair = p.pair AND c.offer_url = p.offer_url
WHERE p.pair IS NULL OR c.pair IS NULL OR c.h IS DISTINCT FROM p.h""",
    "p3_found": r"""
WITH s AS (
  SELECT offer_url, epoch_us(fetched_at) AS us, id, regexp_replace(lower(trim(content_hash)), '^sha256:', '') AS h
  FROM offer_snapshots WHERE offer_url IS NOT NULL AND fetched_at IS NOT NULL),
x AS (SELECT *, lag(h) OVER w AS before, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY offer_url ORDER BY us, id)),
v AS (
  SELECT *, row_number() OVER w AS version_no, lead(us) OVER w AS next_us
  FROM x WHERE rn = 1 OR h IS DISTINCT FROM before WINDOW w AS (PARTITION BY offer_url ORDER BY us, id))
SELECT v.offer_url, CAST(version_no AS INTEGER) AS version_no,
  CASE WHEN version_no = 1 THEN least(us, coalesce(epoch_us(first_seen_at), us)) ELSE us END AS valid_from_us,
  coalesce(next_us, CASE WHEN last_seen_status IN ('missing', 'unavailable') THEN epoch_us(last_seen_at) END, -1) AS valid_to_us
FROM v LEFT JOIN offers o ON o.url = v.offer_url""",
}

SQL = {
    **_SQL,
    "p1_claims": f"""
WITH c AS ({_SQL['p1_found']}),
x AS (SELECT c.*, row_number() OVER (PARTITION BY offer_url ORDER BY r.started_at DESC, c.run_id DESC) AS rn FROM c JOIN runs r ON r.id = c.run_id)
SELECT x.offer_url, x.run_id, x.change_type, o.last_seen_status, (x.change_type = 'removed') = (o.last_seen_status IN ('missing', 'unavailable')) AS agrees
FROM x JOIN offers o ON o.url = x.offer_url WHERE rn = 1""",
    "p3_current": f"""
WITH v AS ({_SQL['p3_found']})
SELECT offer_url, max(version_no) AS versions, max(valid_from_us) AS valid_from_us, count(*) FILTER (WHERE valid_to_us = -1) AS open_versions FROM v GROUP BY 1""",
}

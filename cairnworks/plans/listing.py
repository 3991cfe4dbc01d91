"""The analytical queries over offers, runs, snapshots and the response cache, each with its SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnworks.functions import text as T
from cairnworks.functions.rules import Dictionary, assembled_text, capped_score, cascade
from cairnworks.operators import extract as X
from cairnworks.operators.classify import overlay
from cairnworks.operators.state import cache_lookup, changed_versions, first_wins, last_wins, latest_by, mark_missing, merge_by_key, positioned, top
from cairnworks.sources import sinks as K
from cairnworks.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


_E, _P = T.EMAIL, T.PHONE


def offers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "offers")


LIVE = "NOT coalesce(unavailable, false) AND last_seen_status <> 'missing'"
RANK = "CASE target_bucket WHEN 'primary_target' THEN 1 WHEN 'secondary_target' THEN 2 WHEN 'adjacent_review' THEN 3 ELSE 4 END"


def shortlist(df: DataFrame, min_score: float, since: Column | None = None, source: str | None = None) -> DataFrame:
    out = df.filter(LIVE).filter(f"is_target AND coalesce(ai_category, '') <> 'not_relevant' AND coalesce(ai_relevance_score, 0) >= {min_score}")
    if since is not None:
        out = out.filter(F.col("first_seen_at") >= since)
    if source not in (None, "all"):
        out = out.filter(F.col("source") == source)
    return out


def excluded(df: DataFrame, limit: int = 20) -> DataFrame:
    order = [F.coalesce("ai_relevance_score", F.lit(0.0)).desc(), F.col("title"), F.col("url")]
    return top(df.filter(LIVE).filter("NOT is_target"), limit, *order)


def ranked(df: DataFrame) -> DataFrame:
    return positioned(df, F.expr(RANK), F.col("ai_relevance_score").desc_nulls_last(), "title", "url")


_RANKED = f"row_number() OVER (ORDER BY {RANK}, ai_relevance_score DESC NULLS LAST, title, url) AS position"
_SHORT = f"""SELECT url, title, source, target_bucket, ai_relevance_score FROM offers
WHERE {LIVE} AND is_target AND coalesce(ai_category, '') <> 'not_relevant' AND coalesce(ai_relevance_score, 0) >= 0.35"""
_COLS = ["url", "title", "source", "target_bucket", "ai_relevance_score", "position"]


def _with_place(sql: str) -> str:
    return f"SELECT *, {_RANKED} FROM ({sql})"


@query(_with_place(_SHORT))
def shortlist_ranked(spark, d):
    return ranked(shortlist(offers(spark, d), 0.35)).select(*_COLS)


@query(_with_place(_SHORT + " AND first_seen_at >= (SELECT max(started_at) - INTERVAL 240 DAY FROM runs)"))
def shortlist_since(spark, d):
    """New in the 240 days before the latest run."""
    last = table(spark, d, "runs").agg((F.max("started_at") - F.expr("INTERVAL 240 DAYS")).alias("since"))
    df = shortlist(offers(spark, d), 0.35).join(last, F.col("first_seen_at") >= F.col("since"))
    return ranked(df).select(*_COLS)


@query(_with_place(_SHORT + " AND source = 'anrt'"))
def shortlist_by_source(spark, d):
    return ranked(shortlist(offers(spark, d), 0.35, source="anrt")).select(*_COLS)


_EXCLUDED = f"SELECT url, title, coalesce(ai_relevance_score, 0.0) AS score, row_number() OVER (ORDER BY coalesce(ai_relevance_score, 0.0) DESC, title, url) AS position FROM offers WHERE {LIVE} AND NOT is_target ORDER BY score DESC, title, url LIMIT 20"


@query(_EXCLUDED)
def excluded_topk(spark, d):
    return excluded(offers(spark, d)).select("url", "title", F.coalesce("ai_relevance_score", F.lit(0.0)).alias("score"), "position")


@query("SELECT url, title, ai_relevance_score, row_number() OVER (ORDER BY ai_relevance_score DESC, title, url) AS position FROM offers WHERE ai_relevance_score IS NOT NULL ORDER BY position LIMIT 5")
def top_scores(spark, d):
    return top(offers(spark, d).filter("ai_relevance_score IS NOT NULL"), 5, F.desc("ai_relevance_score"), "title", "url").select("url", "title", "ai_relevance_score", "position")


@query(f"SELECT 0 AS part, url, position FROM ({_with_place(_SHORT)}) UNION ALL SELECT 1 AS part, url, position FROM ({_EXCLUDED})")
def union_with_excluded(spark, d):
    df = offers(spark, d)
    return ranked(shortlist(df, 0.35)).select(F.lit(0).alias("part"), "url", "position").unionByName(excluded(df).select(F.lit(1).alias("part"), "url", "position"))


@query("SELECT url, epoch_us(last_seen_at) AS last_seen_us, row_number() OVER (ORDER BY last_seen_at DESC, url) AS position FROM offers")
def offers_by_last_seen(spark, d):
    return positioned(offers(spark, d).select("url", "last_seen_at"), F.desc("last_seen_at"), "url").select("url", F.unix_micros("last_seen_at").alias("last_seen_us"), "position")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE unavailable) AS unavailable, count(*) FILTER (WHERE last_seen_status = 'missing') AS missing FROM offers")
def audit_totals(spark, d):
    return offers(spark, d).agg(F.count("*").alias("total"), F.count_if("unavailable").alias("unavailable"), F.count_if(F.col("last_seen_status") == "missing").alias("missing"))


def _by_count(groups, key: str) -> DataFrame:
    """Groups, of which there are few, by falling count, then key."""
    counted = groups.agg(F.count("*").alias("n"))
    return counted.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), key)).cast("long")).orderBy("position")


@query("SELECT target_bucket, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, target_bucket) AS position FROM offers GROUP BY 1")
def count_by_bucket(spark, d):
    return _by_count(offers(spark, d).groupBy("target_bucket"), "target_bucket")


@query("SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS position FROM offers GROUP BY 1")
def count_by_source(spark, d):
    return _by_count(offers(spark, d).groupBy("source"), "source")


@query("SELECT coalesce(exclusion_reason, 'none') AS reason, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, coalesce(exclusion_reason, 'none')) AS position FROM offers WHERE NOT is_target GROUP BY 1")
def count_by_exclusion(spark, d):
    return _by_count(offers(spark, d).filter("NOT is_target").groupBy(F.coalesce("exclusion_reason", F.lit("none")).alias("reason")), "reason")


@query("SELECT json_extract_string(source_specific, '$.anrt_kind') AS kind, count(*) AS n FROM offers WHERE json_valid(source_specific) AND json_extract_string(source_specific, '$.anrt_kind') IS NOT NULL GROUP BY 1")
def json_kind_counts(spark, d):
    kind = F.get_json_object("source_specific", "$.anrt_kind")
    return offers(spark, d).select(kind.alias("kind")).filter("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT o.url, o.title, o.source, v.versions, epoch_us(v.first_snapshot) AS first_us, epoch_us(v.last_snapshot) AS last_us FROM (
SELECT offer_url, count(DISTINCT content_hash) AS versions, min(fetched_at) AS first_snapshot, max(fetched_at) AS last_snapshot
FROM offer_snapshots GROUP BY 1 HAVING count(DISTINCT content_hash) > 1) v JOIN offers o ON o.url = v.offer_url""")
def changed_offers(spark, d):
    df = changed_versions(table(spark, d, "offer_snapshots"), offers(spark, d))
    return df.select("url", "title", "source", "versions", F.unix_micros("first_snapshot").alias("first_us"), F.unix_micros("last_snapshot").alias("last_us"))


@query("""SELECT o.url, v.versions, epoch_us(v.last_snapshot) AS last_us, row_number() OVER (ORDER BY v.last_snapshot DESC, o.title, o.url) AS position FROM (
SELECT offer_url, count(DISTINCT content_hash) AS versions, max(fetched_at) AS last_snapshot
FROM offer_snapshots GROUP BY 1 HAVING count(DISTINCT content_hash) > 1) v JOIN offers o ON o.url = v.offer_url
ORDER BY v.last_snapshot DESC, o.title, o.url LIMIT 20""")
def changed_topk(spark, d):
    return top(changed_offers(spark, d), 20, F.desc("last_us"), "title", "url").select("url", "versions", "last_us", "position")


@query("SELECT id, source, epoch_us(started_at) AS started_us, status_message FROM runs ORDER BY started_at DESC, id DESC LIMIT 1")
def latest_run(spark, d):
    return table(spark, d, "runs").orderBy(F.desc("started_at"), F.desc("id")).limit(1).select("id", "source", F.unix_micros("started_at").alias("started_us"), "status_message")


@query("SELECT source, epoch_us(max(started_at)) AS started_us FROM runs GROUP BY 1")
def latest_run_by_source(spark, d):
    return latest_by(table(spark, d, "runs"), ["source"], ["started_at", "id"]).select("source", F.unix_micros("started_at").alias("started_us"))


@query("""SELECT source, count(*) AS runs, CAST(sum(offers_discovered) AS BIGINT) AS discovered, CAST(sum(offers_fetched) AS BIGINT) AS fetched, CAST(sum(errors_count) AS BIGINT) AS errors,
bool_or(lower(trim(status_message)) <> 'ok') AS any_broken FROM runs GROUP BY 1""")
def run_totals(spark, d):
    return table(spark, d, "runs").groupBy("source").agg(
        F.count("*").alias("runs"), F.sum("offers_discovered").alias("discovered"), F.sum("offers_fetched").alias("fetched"), F.sum("errors_count").alias("errors"),
        F.bool_or(F.lower(F.trim("status_message")) != "ok").alias("any_broken"),
    )


@query("""WITH k AS (SELECT *, coalesce(nullif(reference, ''), offer_url) AS dedupe_key FROM offer_snapshots)
SELECT dedupe_key, max_by(offer_url, id) AS offer_url, max_by(content_hash, id) AS content_hash, max(id) AS id, min(id) AS first_position FROM k GROUP BY 1""")
def dedupe_last_wins(spark, d):
    """Key is the reference, or the url where there is none; the last row counts, the first place is kept."""
    key = F.coalesce(T.blank_to_null(F.col("reference")), F.col("offer_url"))
    df = table(spark, d, "offer_snapshots").select("offer_url", "content_hash", "id", key.alias("dedupe_key"))
    return last_wins(df, F.col("dedupe_key"), "id", tie=F.col("offer_url"))


@query("SELECT reference, min(id) AS id FROM offer_snapshots WHERE reference IS NOT NULL GROUP BY 1")
def distinct_first_wins(spark, d):
    df = table(spark, d, "offer_snapshots").filter("reference IS NOT NULL").select("reference", "id")
    return first_wins(df, F.col("reference"), "id", tie=F.col("reference"))


_LAST_OK = "(SELECT id FROM runs WHERE source = 'cnrs' AND finished_at IS NOT NULL AND lower(trim(status_message)) = 'ok' ORDER BY started_at DESC, id DESC LIMIT 1)"


def _seen_in_last_run(spark, d) -> DataFrame:
    runs = table(spark, d, "runs").filter("source = 'cnrs' AND finished_at IS NOT NULL AND lower(trim(status_message)) = 'ok'")
    last = runs.orderBy(F.desc("started_at"), F.desc("id")).limit(1).select(F.col("id").alias("run_id"))
    return table(spark, d, "offer_snapshots").join(last, "run_id", "left_semi").select(F.col("offer_url").alias("url")).distinct()


@query(f"""SELECT url FROM offers WHERE source = 'cnrs' AND {LIVE}
AND NOT EXISTS (SELECT 1 FROM offer_snapshots s WHERE s.offer_url = offers.url AND s.run_id = {_LAST_OK})""")
def missing_anti_join(spark, d):
    known = offers(spark, d).filter(LIVE).filter("source = 'cnrs'")
    return known.join(_seen_in_last_run(spark, d), "url", "left_anti").select("url")


@query(f"""SELECT url, CASE WHEN source = 'cnrs' AND {LIVE} AND NOT EXISTS (SELECT 1 FROM offer_snapshots s WHERE s.offer_url = offers.url AND s.run_id = {_LAST_OK})
THEN 'missing' ELSE last_seen_status END AS last_seen_status FROM offers""")
def mark_missing_state(spark, d):
    df = offers(spark, d)
    within = F.expr(LIVE) & (F.col("source") == "cnrs")
    return mark_missing(df, _seen_in_last_run(spark, d), "url", within=within, now=F.lit("2030-01-01").cast("timestamp"), complete=True).select("url", "last_seen_status")


@query("""WITH n AS (SELECT offer_url AS url, max(fetched_at) AS first_seen_at FROM offer_snapshots GROUP BY 1)
SELECT coalesce(o.url, n.url) AS url, epoch_us(coalesce(o.first_seen_at, n.first_seen_at)) AS first_us, o.title,
CASE WHEN n.url IS NOT NULL THEN 'seen' ELSE o.last_seen_status END AS last_seen_status FROM offers o FULL JOIN n ON n.url = o.url""")
def merge_upsert(spark, d):
    """Every fetched url is merged into the state; a reappearing one becomes `seen`, its first_seen_at stays."""
    incoming = table(spark, d, "offer_snapshots").groupBy(F.col("offer_url").alias("url")).agg(F.max("fetched_at").alias("first_seen_at"))
    current = offers(spark, d).select("url", "first_seen_at", "title", "last_seen_status")
    merged = merge_by_key(current, incoming, "url", keep=["first_seen_at"], touch={"last_seen_status": F.lit("seen")})
    return merged.select("url", F.unix_micros("first_seen_at").alias("first_us"), "title", "last_seen_status")


@query("SELECT count(*) FILTER (WHERE c.content_hash IS NOT NULL) AS hits, count(*) FILTER (WHERE c.content_hash IS NULL) AS misses FROM offers o LEFT JOIN (SELECT * FROM llm_cache WHERE classifier_version = 'hybrid-v1') c ON c.content_hash = o.content_hash WHERE o.content_hash IS NOT NULL")
def cache_hits(spark, d):
    hit, miss = cache_lookup(offers(spark, d).filter("content_hash IS NOT NULL").select("content_hash"), table(spark, d, "llm_cache"), "hybrid-v1")
    return hit.agg(F.count("*").alias("hits")).crossJoin(miss.agg(F.count("*").alias("misses")))  # two single rows


CACHED = ("is_target", "target_bucket", "relevance_score", "risk_flags")  # what the cached answers hold


@query("""WITH c AS (SELECT content_hash, min(response_json) AS r FROM llm_cache WHERE classifier_version = 'hybrid-v1' GROUP BY 1),
x AS (SELECT o.*, c.r, CASE WHEN json_valid(c.r) THEN CAST(c.r AS JSON) END AS j FROM offers o LEFT JOIN c ON c.content_hash = o.content_hash),
v AS (SELECT *, coalesce(list_sort(json_keys(j)) = ['is_target', 'relevance_score', 'risk_flags', 'target_bucket'] AND json_type(j, '$.is_target') = 'BOOLEAN' AND json_extract_string(j, '$.target_bucket') IN ('primary_target', 'secondary_target', 'adjacent_review', 'exclude')
 AND json_type(j, '$.relevance_score') IN ('DOUBLE', 'BIGINT', 'UBIGINT') AND CAST(json_extract_string(j, '$.relevance_score') AS DOUBLE) BETWEEN 0 AND 1 AND json_type(j, '$.risk_flags') = 'ARRAY', false) AS valid FROM x)
SELECT url, CASE WHEN r IS NULL THEN 'none' WHEN valid THEN 'valid' ELSE 'invalid' END AS answered,
CASE WHEN valid THEN json_extract_string(j, '$.target_bucket') WHEN r IS NOT NULL AND is_target THEN 'adjacent_review' ELSE target_bucket END AS target_bucket,
CASE WHEN valid THEN json_extract_string(j, '$.is_target') = 'true' ELSE is_target END AS is_target, accessibility, ai_category,
CASE WHEN valid THEN CAST(json_extract_string(j, '$.relevance_score') AS DOUBLE) ELSE ai_relevance_score END AS score,
array_to_string(CASE WHEN valid THEN CAST(json_extract(j, '$.risk_flags') AS VARCHAR[]) WHEN r IS NOT NULL THEN list_sort(list_distinct(list_concat(coalesce(risk_flags, []), ['llm_invalid_response']))) ELSE risk_flags END, ',') AS flags,
CASE WHEN valid THEN 'hybrid-v1' ELSE classifier_version END AS version FROM v""")
def response_overlay(spark, d):
    """Cached answers laid over the stored values after strict validation; from_json alone is permissive."""
    held = table(spark, d, "llm_cache").filter("classifier_version = 'hybrid-v1'").groupBy("content_hash").agg(F.min("response_json").alias("response_json"))
    rows = overlay(offers(spark, d).join(held, "content_hash", "left"), "response_json", "hybrid-v1", CACHED)
    return rows.select("url", "answered", "target_bucket", "is_target", "accessibility", "ai_category", F.col("ai_relevance_score").alias("score"), F.array_join("risk_flags", ",").alias("flags"), F.col("classifier_version").alias("version"))


# --- rule packs ------------------------------------------------------------------------------------------

STRONG = Dictionary((("apprentissage", "machine_learning"), ("deep learning", "machine_learning"), ("bayésien", "statistics"), ("bayesian", "statistics"), ("traitement automatique", "language"), ("natural language", "language"), ("vision", "vision")))
ADJACENT = Dictionary((("données", "data"), ("data", "data"), ("signal", "signal"), ("simulation", "simulation")))
_TEXT = "lower(concat_ws(' ', nullif(title, ''), nullif(contract_type, ''), nullif(education_level, ''), nullif(CASE WHEN concat_ws(' ', nullif(description, ''), nullif(skills, '')) = '' THEN coalesce(raw_text, '') ELSE concat_ws(' ', nullif(description, ''), nullif(skills, '')) END, '')))"


def _counted(pack: Dictionary, text: str = "t") -> str:
    return " + ".join(f"CASE WHEN contains({text}, '{term}') THEN 1 ELSE 0 END" for term, _ in pack.entries)


def _offer_text() -> Column:
    return assembled_text("title", "contract_type", "education_level", body=("description", "skills"), fallback="raw_text")


@query(f"""WITH x AS (SELECT url, {_TEXT} AS t FROM offers), terms(term, label) AS (VALUES {', '.join(f"('{t}', '{label}')" for t, label in STRONG.entries)})
SELECT url, label, count(*) AS hits FROM x JOIN terms ON contains(x.t, terms.term) GROUP BY 1, 2""")
def term_hits(spark, d):
    """Every (offer, term) that matches, by label; a literal array and a filter instead of a join."""
    df = offers(spark, d).select("url", _offer_text().alias("t")).select("url", F.explode(STRONG.labels(F.col("t"))).alias("label"))
    return df.groupBy("url", "label").agg(F.count("*").alias("hits"))


@query(f"""WITH x AS (SELECT url, {_TEXT} AS t FROM offers), y AS (SELECT url, {_counted(STRONG)} AS strong, {_counted(ADJACENT)} AS adjacent FROM x)
SELECT url, strong, adjacent, greatest(least(least(strong * 14, 56) + least(adjacent * 6, 18), 100), 0) / 100.0::DOUBLE AS score,
CASE WHEN strong >= 3 THEN 'core' WHEN strong >= 1 AND adjacent >= 1 THEN 'mixed' WHEN strong >= 1 OR adjacent >= 2 THEN 'near' ELSE 'far' END AS band FROM y""")
def rule_scores(spark, d):
    """Capped dictionary scores in whole hundredths and the first rule of an ordered cascade that holds."""
    df = offers(spark, d).select("url", _offer_text().alias("t")).select("url", F.size(STRONG.labels(F.col("t"))).alias("strong"), F.size(ADJACENT.labels(F.col("t"))).alias("adjacent"))
    s, a = F.col("strong"), F.col("adjacent")
    band = cascade([(s >= 3, "core"), ((s >= 1) & (a >= 1), "mixed"), ((s >= 1) | (a >= 2), "near")], "far")
    return df.select("url", "strong", "adjacent", capped_score([(s, 14, 56), (a, 6, 18)]).alias("score"), band.alias("band"))


_PREDICTED = f"WITH x AS (SELECT item_id, expected_bucket, lower(concat_ws(' ', title, text)) AS t FROM eval_items), p AS (SELECT item_id, expected_bucket, expected_bucket <> 'exclude' AS expected, ({_counted(STRONG)}) >= 1 AS predicted FROM x)"


def _predictions(spark, d) -> DataFrame:
    t = F.lower(F.concat_ws(" ", "title", "text"))
    return table(spark, d, "eval_items").select("item_id", (F.col("expected_bucket") != "exclude").alias("expected"), (F.size(STRONG.labels(t)) >= 1).alias("predicted"))


def safe_ratio(n: Column, d: Column, digits: int = 3) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(F.bround(n / d, digits))


@query(_PREDICTED + """, c AS (SELECT count(*) AS total, CAST(count_if(expected = predicted) AS BIGINT) AS correct, CAST(count_if(expected AND predicted) AS BIGINT) AS tp, CAST(count_if(NOT expected AND predicted) AS BIGINT) AS false_targets, CAST(count_if(expected AND NOT predicted) AS BIGINT) AS missed_targets FROM p)
SELECT total, correct, false_targets, missed_targets, CASE WHEN total = 0 THEN 0.0 ELSE round_even(correct::DOUBLE / total, 3) END AS accuracy,
CASE WHEN tp + false_targets = 0 THEN 0.0 ELSE round_even(tp::DOUBLE / (tp + false_targets), 3) END AS precision, CASE WHEN tp + missed_targets = 0 THEN 0.0 ELSE round_even(tp::DOUBLE / (tp + missed_targets), 3) END AS recall FROM c""")
def eval_metrics(spark, d):
    e, p = F.col("expected"), F.col("predicted")
    c = _predictions(spark, d).agg(
        F.count("*").alias("total"), F.count_if(e == p).alias("correct"), F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("false_targets"), F.count_if(e & ~p).alias("missed_targets")
    )
    tp = F.col("tp")
    return c.select(
        "total", "correct", "false_targets", "missed_targets", safe_ratio(F.col("correct"), F.col("total")).alias("accuracy"),
        safe_ratio(tp, tp + F.col("false_targets")).alias("precision"), safe_ratio(tp, tp + F.col("missed_targets")).alias("recall"),
    )


@query(_PREDICTED + " SELECT item_id, expected, predicted FROM p WHERE expected <> predicted")
def eval_mismatches(spark, d):
    return _predictions(spark, d).filter("expected <> predicted")


PROFILES = {
    "all": "true",
    "doctoral": "coalesce(contains(lower(contract_type), 'doctorant'), false) OR coalesce(contains(url, '/Doctorant/'), false)",
    "fixed_term": "coalesce(contains(lower(contract_type), 'cdd'), false) AND coalesce(contains(lower(education_level), '5'), false)",
    "learning": "contains(lower(concat_ws(' ', title, contract_type, education_level, raw_text)), 'apprentissage')",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS profile, CAST(count_if({e}) AS BIGINT) AS offers FROM offers" for k, e in PROFILES.items()))
def profile_audit(spark, d):
    """Overlapping predicates in one pass over the table."""
    one = offers(spark, d).agg(*[F.count_if(F.expr(e)).alias(k) for k, e in PROFILES.items()])
    return one.selectExpr(f"stack({len(PROFILES)}, " + ", ".join(f"'{k}', {k}" for k in PROFILES) + ") AS (profile, offers)")


@query(f"SELECT url FROM offers WHERE {PROFILES['doctoral']}")
def profile_doctoral(spark, d):
    return offers(spark, d).filter(PROFILES["doctoral"]).select("url")


@query(f"SELECT url FROM offers WHERE {PROFILES['fixed_term']}")
def profile_fixed_term(spark, d):
    return offers(spark, d).filter(PROFILES["fixed_term"]).select("url")


@query(f"SELECT url FROM offers WHERE {PROFILES['learning']}")
def profile_learning(spark, d):
    return offers(spark, d).filter(PROFILES["learning"]).select("url")


# --- text ------------------------------------------------------------------------------------------------

@query(f"SELECT url, regexp_matches(raw_text, '{_E}') OR regexp_matches(raw_text, '{_P}') AS has_contact FROM offers")
def contact_flag(spark, d):
    return offers(spark, d).select("url", T.has_contact(F.col("raw_text")).alias("has_contact"))


@query(f"SELECT count(*) AS pages, CAST(count_if(len(list_filter(regexp_extract_all(raw_text, '{_E}'), lambda x: x <> '{T.EMAIL_PLACEHOLDER}')) > 0 OR regexp_matches(raw_text, '{_P}')) AS BIGINT) AS leaking FROM offers")
def contact_leaks(spark, d):
    return offers(spark, d).agg(F.count("*").alias("pages"), F.count_if(T.leaks_contact(F.col("raw_text"))).alias("leaking"))


@query(f"SELECT url, regexp_replace(regexp_replace(description, '{_E}', '{T.EMAIL_PLACEHOLDER}', 'g'), '{_P}', '{T.PHONE_PLACEHOLDER}', 'g') AS description FROM offers")
def anonymised_text(spark, d):
    return offers(spark, d).select("url", T.anonymised(F.col("description")).alias("description"))


@query(r"SELECT url, nullif(trim(regexp_replace(raw_text, '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}\x{000b}\x1c-\x1f]+', ' ', 'g')), '') AS text FROM offers")
def clean_text(spark, d):
    return offers(spark, d).select("url", T.text_or_null(F.col("raw_text")).alias("text"))


@query("SELECT url, sha256(raw_text) AS digest FROM offers")
def sha256_payload(spark, d):
    return offers(spark, d).select("url", F.sha2("raw_text", 256).alias("digest"))


@query("SELECT url, regexp_replace(url, '^https?://[^/]+', '') AS path, CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE 'https://' || url END AS absolute FROM offers")
def url_parts(spark, d):
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    return offers(spark, d).select("url", path.alias("path"), T.with_scheme(F.col("url"), "portal.example").alias("absolute"))


@query("SELECT url, list_last(string_split(regexp_replace(url, '/+$', ''), '/')) AS reference FROM offers")
def reference_from_url(spark, d):
    return offers(spark, d).select("url", T.reference_of_url(F.col("url")).alias("reference"))


def _slug_sql(column: str) -> str:
    """Characters whose compatibility decomposition has one ASCII character become that one; ligatures two; others go."""
    plain = {c: x for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and len(x := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) == 1 and x != "'"}
    out = f"translate({column}, '{''.join(plain)}', '{''.join(plain.values())}')"
    for c in "ﬀﬁﬂﬃﬄﬅﬆ…½":
        out = f"replace({out}, '{c}', '{unicodedata.normalize('NFKD', c).encode('ascii', 'ignore').decode()}')"
    return f"coalesce(nullif(lower(trim(regexp_replace(regexp_replace({out}, '[^\\x00-\\x7f]+', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '-')), ''), 'snapshot')"


@query(f"SELECT url, {_slug_sql('title')} AS slug FROM offers")
def title_slugs(spark, d):
    return T.with_slug(offers(spark, d).select("url", "title"), "title").select("url", "slug")


@query("""WITH x AS (SELECT url, list_filter([contract_type, duration, education_level], lambda v: v IS NOT NULL) AS labels FROM offers)
SELECT url, labels[1] AS contract, list_filter(labels[2:], lambda v: contains(lower(v), 'mois'))[1] AS duration, list_filter(labels[2:], lambda v: contains(lower(v), 'bac'))[1] AS education FROM x""")
def label_split(spark, d):
    """The first label is the contract; of the later ones the first with `mois` and the first with `bac`."""
    df = offers(spark, d).select("url", F.filter(F.array("contract_type", "duration", "education_level"), lambda v: v.isNotNull()).alias("labels"))
    later = F.slice("labels", 2, 100)
    first = lambda part: F.get(F.filter(later, lambda v: F.contains(F.lower(v), F.lit(part))), 0)
    return df.select("url", F.get("labels", 0).alias("contract"), first("mois").alias("duration"), first("bac").alias("education"))


def _phrase(p: str) -> str:
    return "contains(lower(raw_text), '" + p.replace("'", "''") + "')"


@query("SELECT url, CASE WHEN trim(raw_text) = '' THEN 'empty' " + " ".join(f"WHEN {' OR '.join(map(_phrase, ps))} THEN '{k}'" for k, ps in X.PAGE_STATES) + " ELSE 'record' END AS page_state FROM offers")
def page_state(spark, d):
    """The first state whose phrases a page holds; states are a column, so that bad pages can be set aside."""
    return offers(spark, d).select("url", X.page_states(F.col("raw_text")).alias("page_state"))


@query(r"SELECT url, TRY_CAST(nullif(regexp_extract(raw_text, '([0-9]+) personnes consultent', 1), '') AS INTEGER) AS viewers FROM offers WHERE regexp_matches(raw_text, '[0-9]+ personnes consultent')")
def page_counters(spark, d):
    return offers(spark, d).filter(F.col("raw_text").rlike("[0-9]+ personnes consultent")).select("url", F.expr(r"try_cast(nullif(regexp_extract(raw_text, '([0-9]+) personnes consultent', 1), '') AS INT)").alias("viewers"))


# --- output rows -----------------------------------------------------------------------------------------


NAMES, KINDS = {"cnrs": "Public research", "anrt": "Members"}, {"entreprise": "Company", "laboratoire": "Laboratory"}
_JSON = "json_extract_string(source_specific, '$.{}')"
_KIND = _JSON.format("anrt_kind")
_ORIGIN = "CASE " + " ".join(f"WHEN source = 'anrt' AND {_KIND} = '{k}' THEN '{v}'" for k, v in KINDS.items()) + " ".join(f" WHEN source = '{k}' THEN '{v}'" for k, v in NAMES.items()) + " ELSE source END"
_CSV = {**{c: f"CAST({c} AS VARCHAR)" for c in ("reference", "source", "title", "contract_type", "duration", "education_level", "location", "lab", "published_at_text", "why_interesting", "url")}, **{k: _JSON.format(v) for k, v in K.SPECIFIC.items()}}
_CSV |= {"origin": _ORIGIN, "bucket": "target_bucket", "score": "CAST(ai_relevance_score AS VARCHAR)", "contract": "contract_type", "level": "education_level", "category": "ai_category", "summary": "short_summary", "reason": "ai_reason", "flags": "array_to_string(risk_flags, ',')"}


@query("SELECT " + ", ".join(f"coalesce({_CSV[c]}, '') AS {c}" for c in K.CSV_COLUMNS) + " FROM offers")
def csv_rows(spark, d):
    """The 31 columns of the export."""
    return K.csv_columns(offers(spark, d), K.display_origin(NAMES, KINDS))


def _line(label: str, column: str) -> str:
    return f"'- {label} : ' || coalesce(nullif({column}, ''), 'n/a')"


_DETAILS = ", ".join("'- {} : ' || {}".format(label, f"CASE {_JSON.format(k)} WHEN 'true' THEN 'oui' WHEN 'false' THEN 'non' END" if k == "contact_visible" else f"nullif({_JSON.format(k)}, '')") for k, label in K.DETAIL_LABELS.items())
_BLOCK = (
    f"'### ' || title || chr(10) || chr(10) || '- Source : ' || {_ORIGIN} || chr(10) || array_to_string(list_filter([{', '.join(_line(k, c) for k, c in K.BLOCK_LABELS.items())}] || CASE WHEN source = 'anrt' THEN [{_DETAILS}] ELSE [] END || "
    f"['- Score : ' || coalesce(printf('%.2f', ai_relevance_score), 'n/a'), {', '.join(_line(k, c) for k, c in K.BLOCK_TEXTS.items())}, '- Flags : ' || coalesce(nullif(array_to_string(risk_flags, ', '), ''), 'aucun'), '- Lien : ' || url], lambda v: v IS NOT NULL), chr(10))"
)


@query(f"SELECT url, {_BLOCK} AS block FROM offers WHERE {LIVE} AND is_target")
def markdown_blocks(spark, d):
    """Every line of a digest entry, detail lines of the members' portal included."""
    return offers(spark, d).filter(LIVE).filter("is_target").select("url", K.offer_block(K.display_origin(NAMES, KINDS)).alias("block"))


def _masked(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{_E}', '{T.EMAIL_PLACEHOLDER}', 'g'), '{_P}', '{T.PHONE_PLACEHOLDER}', 'g')"


@query(f"""SELECT url, row_number() OVER (ORDER BY {RANK}, coalesce(ai_relevance_score, 0) DESC, title, url) AS position, coalesce(nullif(reference, ''), url) AS reference, target_bucket AS expected_bucket, coalesce(ai_category, 'not_relevant') AS expected_ai_domain,
accessibility AS expected_accessibility, {_masked('title')} AS title, {_masked('description')} AS description, {_masked('raw_text')} AS raw_text, {_masked(_JSON.format('company_name'))} AS company FROM offers WHERE source = 'anrt' AND {LIVE} AND coalesce(ai_relevance_score, 0) >= 0.1
ORDER BY position LIMIT 40""")
def seed_cases(spark, d):
    """The first cases to be labelled, contacts masked in all their texts."""
    rows = top(offers(spark, d).filter(LIVE).filter("source = 'anrt' AND coalesce(ai_relevance_score, 0) >= 0.1"), 40, F.expr(RANK), F.coalesce("ai_relevance_score", F.lit(0.0)).desc(), "title", "url")
    x = rows.select("url", "position", K.seed_case().alias("x"))
    return x.select("url", "position", *[f"x.{c}" for c in ("reference", "expected_bucket", "expected_ai_domain", "expected_accessibility")], *[f"x.offer.{c}" for c in ("title", "description", "raw_text")], F.col("x.offer.source_specific")["company_name"].alias("company"))


GATES = ("has_offers", "latest_run_finished", "latest_run_ok", "discovered_minimum", "fetched_minimum", "both_origins_present", "has_primary_target", "labelled_minimum", "no_broken_rows", "no_contact_in_titles")


@query(f"""WITH r AS (SELECT * FROM runs WHERE source = 'anrt' ORDER BY started_at DESC, id DESC LIMIT 1), o AS (SELECT * FROM offers WHERE source = 'anrt'),
g AS (SELECT 'has_offers' AS gate, count(*) > 0 AS passed, CAST(count(*) AS VARCHAR) AS detail FROM o
UNION ALL SELECT 'latest_run_finished', coalesce(bool_or(finished_at IS NOT NULL), false), coalesce(CAST(max(id) AS VARCHAR), 'n/a') FROM r
UNION ALL SELECT 'latest_run_ok', coalesce(bool_or(coalesce(lower(trim(status_message)), '') IN ('', 'ok') AND errors_count = 0), false), coalesce(max(errors_count), 0) || ' errors' FROM r
UNION ALL SELECT 'discovered_minimum', coalesce(max(offers_discovered), 0) >= 20, coalesce(max(offers_discovered), 0) || '/20' FROM r
UNION ALL SELECT 'fetched_minimum', coalesce(max(offers_fetched), 0) >= 20, coalesce(max(offers_fetched), 0) || '/20' FROM r
UNION ALL SELECT 'both_origins_present', count(*) FILTER (WHERE {LIVE} AND {_KIND} = 'entreprise') > 0 AND count(*) FILTER (WHERE {LIVE} AND {_KIND} = 'laboratoire') > 0, count(*) FILTER (WHERE {LIVE} AND {_KIND} = 'entreprise') || ' and ' || count(*) FILTER (WHERE {LIVE} AND {_KIND} = 'laboratoire') FROM o
UNION ALL SELECT 'has_primary_target', count(*) FILTER (WHERE target_bucket = 'primary_target') > 0, CAST(count(*) FILTER (WHERE target_bucket = 'primary_target') AS VARCHAR) FROM o
UNION ALL SELECT 'labelled_minimum', count(*) >= 20, count(*) || '/20' FROM eval_items
UNION ALL SELECT 'no_broken_rows', count(*) FILTER (WHERE coalesce(title, '') = '' OR ai_relevance_score NOT BETWEEN 0 AND 1) = 0, CAST(count(*) FILTER (WHERE coalesce(title, '') = '' OR ai_relevance_score NOT BETWEEN 0 AND 1) AS VARCHAR) FROM o
UNION ALL SELECT 'no_contact_in_titles', count(*) FILTER (WHERE regexp_matches(title, '{_E}|{_P}')) = 0, CAST(count(*) FILTER (WHERE regexp_matches(title, '{_E}|{_P}')) AS VARCHAR) FROM o)
SELECT gate, passed, detail FROM g UNION ALL SELECT 'all', bool_and(passed), count(*) FILTER (WHERE passed) || '/' || count(*) FROM g""")
def gate_report(spark, d):
    """One pass over each table, then one row per gate and one for all."""
    df, live = offers(spark, d).filter("source = 'anrt'"), F.expr(LIVE)
    kind, bad = F.get_json_object("source_specific", "$.anrt_kind"), F.expr("coalesce(title, '') = '' OR ai_relevance_score NOT BETWEEN 0 AND 1")
    o = df.agg(
        F.count("*").alias("offers"), F.count_if(live & (kind == "entreprise")).alias("companies"), F.count_if(live & (kind == "laboratoire")).alias("labs"), F.count_if(F.col("target_bucket") == "primary_target").alias("primary"),
        F.count_if(bad).alias("broken"), F.count_if(T.has_contact(F.col("title"))).alias("contacts"),
    )
    run = table(spark, d, "runs").filter("source = 'anrt'").orderBy(F.desc("started_at"), F.desc("id")).limit(1).agg(
        F.max("id").alias("run"), F.coalesce(F.bool_or(F.col("finished_at").isNotNull()), F.lit(False)).alias("finished"), F.coalesce(F.max("errors_count"), F.lit(0)).alias("errors"), F.coalesce(F.max("offers_discovered"), F.lit(0)).alias("discovered"),
        F.coalesce(F.max("offers_fetched"), F.lit(0)).alias("fetched"), F.coalesce(F.bool_or(F.coalesce(F.lower(F.trim("status_message")), F.lit("")).isin("", "ok") & (F.col("errors_count") == 0)), F.lit(False)).alias("fine"),
    )
    one = o.crossJoin(run).crossJoin(table(spark, d, "eval_items").agg(F.count("*").alias("cases")))  # single rows
    text = lambda c: F.col(c).cast("string")
    rules = {
        "has_offers": (F.col("offers") > 0, text("offers")), "latest_run_finished": (F.col("finished"), F.coalesce(text("run"), F.lit("n/a"))), "latest_run_ok": (F.col("fine"), F.concat(text("errors"), F.lit(" errors"))),
        "discovered_minimum": (F.col("discovered") >= 20, F.concat(text("discovered"), F.lit("/20"))), "fetched_minimum": (F.col("fetched") >= 20, F.concat(text("fetched"), F.lit("/20"))),
        "both_origins_present": ((F.col("companies") > 0) & (F.col("labs") > 0), F.concat(text("companies"), F.lit(" and "), text("labs"))), "has_primary_target": (F.col("primary") > 0, text("primary")),
        "labelled_minimum": (F.col("cases") >= 20, F.concat(text("cases"), F.lit("/20"))), "no_broken_rows": (F.col("broken") == 0, text("broken")), "no_contact_in_titles": (F.col("contacts") == 0, text("contacts")),
    }
    listed = F.array(*[F.struct(F.lit(g).alias("gate"), rules[g][0].alias("passed"), rules[g][1].alias("detail")) for g in GATES])
    done = F.size(F.filter("g", lambda x: x["passed"]))
    whole = F.struct(F.lit("all").alias("gate"), (done == len(GATES)).alias("passed"), F.concat(done.cast("string"), F.lit(f"/{len(GATES)}")).alias("detail"))
    return one.select(listed.alias("g")).select(F.explode(F.concat("g", F.array(whole))).alias("x")).select("x.*")


@query("SELECT offer_url AS url, count(*) AS fetches, epoch_us(min(fetched_at)) AS first_us, epoch_us(max(fetched_at)) AS last_us FROM offer_snapshots GROUP BY 1")
def version_span(spark, d):
    return table(spark, d, "offer_snapshots").groupBy(F.col("offer_url").alias("url")).agg(F.count("*").alias("fetches"), F.unix_micros(F.min("fetched_at")).alias("first_us"), F.unix_micros(F.max("fetched_at")).alias("last_us"))


@query("SELECT url, list_sort(list_distinct(list_concat(coalesce(risk_flags, []), ['checked']))) AS flags FROM offers")
def union_of_flags(spark, d):
    return offers(spark, d).select("url", F.array_sort(F.array_union(F.coalesce("risk_flags", F.expr("cast(array() AS array<string>)")), F.array(F.lit("checked")))).alias("flags"))


@query("""SELECT target_bucket, string_agg(url, ' ' ORDER BY ai_relevance_score DESC NULLS LAST, url) AS urls FROM (SELECT *, row_number() OVER (PARTITION BY target_bucket ORDER BY ai_relevance_score DESC NULLS LAST, url) AS rn FROM offers) WHERE rn <= 3 GROUP BY 1""")
def bucket_leaders(spark, d):
    """The three best of each bucket, in order."""
    w = Window.partitionBy("target_bucket").orderBy(F.col("ai_relevance_score").desc_nulls_last(), "url")
    top = offers(spark, d).select("target_bucket", "url", F.row_number().over(w).alias("rn")).filter("rn <= 3")
    return top.groupBy("target_bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "url"))), lambda x: x["url"]), " ").alias("urls"))

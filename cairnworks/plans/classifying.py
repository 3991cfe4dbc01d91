"""Classification queries: a pack of our own, the outcome of its rules, the labelled cases, requests and broken rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.functions.rules import Dictionary
from cairnworks.operators import classify as C
from cairnworks.plans.listing import safe_ratio
from cairnworks.runtime import table
from cairnworks.schemas import OFFER_RULES, broken_rules

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


PACK = C.Pack(
    version="pack-1",
    strong=Dictionary((("apprentissage profond", "deep learning"), ("deep learning", "deep learning"), ("apprentissage par renforcement", "reinforcement"), ("reinforcement learning", "reinforcement"), ("vision par ordinateur", "vision"), ("computer vision", "vision"), ("transformer", "transformers"), ("traitement automatique des langues", "language"), ("natural language processing", "language"))),
    adjacent=Dictionary((("fouille de graphes", "graphs"), ("graph mining", "graphs"), ("statisti", "statistics"), ("bayésien", "bayes"), ("bayesian", "bayes"), ("optimisation", "optimisation"), ("données", "data"))),
    negative=("télédétection", "remote sensing"), special=("transformers",), barred=("stage", "cdi"), too_high=("doctorat requis", "phd required", "titulaire d'un doctorat"), too_high_named=("post-doc", "postdoc"),
    thesis_contracts=("cdd doctorant", "contrat doctoral", "doctorant"), thesis_titles=("thèse", "these", "doctorant", "contrat doctoral"), thesis_path="/offres/doctorant/", open_levels=("bac+5", "bac +5", "master"), fixed_term="cdd",
    engineers=("ingénieur", "engineer"), low_levels=("bac+3", "bac+4"),
)


def _any(text: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, t.replace("'", "''")) for t in terms) + ")"


def _first(text: str, terms: tuple[str, ...]) -> str:
    return "CASE " + " ".join("WHEN contains({0}, '{1}') THEN '{1}'".format(text, t.replace("'", "''")) for t in terms) + " END"


def _labels(pack: Dictionary) -> str:
    listed = ", ".join(f"{{'t': '{t}', 'l': '{label}'}}" for t, label in pack.entries)
    return f"list_transform(list_filter([{listed}], lambda w: contains(t, w.t)), lambda w: w.l)"


def _scored(source: str) -> str:
    """Common table expressions up to `s`: the rows of `source` with all parts of the score."""
    p = PACK
    return f"""b AS (SELECT *, concat_ws(' ', nullif(description, ''), nullif(skills, '')) AS body, lower(coalesce(contract_type, '')) AS contract, lower(coalesce(education_level, '')) AS level FROM {source}),
x AS (SELECT *, lower(concat_ws(' ', nullif(title, ''), nullif(contract_type, ''), nullif(education_level, ''), nullif(CASE WHEN body = '' THEN coalesce(raw_text, '') ELSE body END, ''))) AS t,
 lower(concat_ws(' ', nullif(title, ''), nullif(contract_type, ''), nullif(education_level, ''), nullif(url, ''))) AS named FROM b),
h AS (SELECT *, {_labels(p.strong)} AS strong_hits, {_labels(p.adjacent)} AS adjacent_hits, {_first('t', p.negative)} AS negative_hit, {_first('contract', p.barred)} AS barred,
 {_any('contract', p.thesis_contracts)} OR {_any('lower(title)', p.thesis_titles)} OR contains(lower(url), '{p.thesis_path}') AS thesis, {_any('t', p.too_high)} OR {_any('named', p.too_high_named)} AS too_high,
 contains(contract, '{p.fixed_term}') AND ({_any('contract', p.engineers)} OR {_any('t', p.engineers)}) AND ({_any('level', p.open_levels)} OR {_any('t', p.open_levels)}) AS fixed FROM x),
e AS (SELECT *, CASE WHEN barred IS NOT NULL THEN 'not_target' WHEN too_high THEN 'not_target' WHEN source = 'anrt' AND contains(contract, 'cifre') OR thesis THEN 'thesis_or_bac5_cdd' WHEN fixed THEN 'bac5_cdd' ELSE 'not_target' END AS target_type,
 CASE WHEN barred IS NOT NULL THEN 'not_accessible' WHEN too_high THEN 'doctorate_required' WHEN source = 'anrt' AND contains(contract, 'cifre') THEN 'bac5_accessible'
  WHEN thesis THEN CASE WHEN {_any('level', p.open_levels)} OR contains(contract, 'doctorant') THEN 'bac5_accessible' ELSE 'unclear' END WHEN fixed THEN 'bac5_accessible' ELSE 'unclear' END AS accessible,
 CASE WHEN barred IS NOT NULL THEN 'excluded_contract:' || barred WHEN too_high THEN 'doctorate_required' WHEN source = 'anrt' AND contains(contract, 'cifre') OR thesis OR fixed THEN NULL ELSE 'not_contract_or_level_target' END AS why,
 CASE WHEN negative_hit IS NOT NULL THEN 'not_relevant' WHEN list_has_any(strong_hits, [{', '.join(repr(x) for x in p.special)}]) THEN 'generative_ai' WHEN len(strong_hits) > 0 THEN 'ml_deep_learning' WHEN len(adjacent_hits) > 0 THEN 'data_science_adjacent' ELSE 'not_relevant' END AS domain FROM h),
s AS (SELECT *, greatest(least(CASE WHEN target_type <> 'not_target' THEN 25 ELSE 0 END + least(len(strong_hits) * 14, 56) + least(len(adjacent_hits) * 6, 18) + CASE WHEN thesis THEN 8 ELSE 0 END - CASE WHEN negative_hit IS NOT NULL THEN 25 ELSE 0 END, 100), 0) / 100.0::DOUBLE AS score FROM e)"""


def _decided(source: str) -> str:
    """Further expressions up to `d`: bucket, exclusion reason and flags."""
    p = PACK
    return _scored(source) + f""",
c AS (SELECT *, CASE WHEN coalesce(unavailable, false) THEN 1 WHEN starts_with(why, 'excluded_contract:') THEN 2 WHEN accessible = 'doctorate_required' THEN 3 WHEN negative_hit IS NOT NULL THEN 4 WHEN domain = 'not_relevant' THEN 5
 WHEN source = 'anrt' AND target_type = 'thesis_or_bac5_cdd' AND domain = 'data_science_adjacent' THEN 6 WHEN target_type = 'thesis_or_bac5_cdd' THEN 7 WHEN target_type = 'bac5_cdd' THEN 8 WHEN domain = 'data_science_adjacent' AND score >= {p.near_score} THEN 9
 WHEN score < {p.least_score} THEN 10 ELSE 11 END AS rule FROM s),
d AS (SELECT *, CASE WHEN rule IN (6, 9, 11) THEN 'adjacent_review' WHEN rule = 7 THEN 'primary_target' WHEN rule = 8 THEN 'secondary_target' ELSE 'exclude' END AS bucket,
 CASE rule WHEN 1 THEN 'expired_or_unavailable' WHEN 2 THEN why WHEN 3 THEN 'doctorate_required_or_postdoc' WHEN 4 THEN 'negative_signal:' || negative_hit WHEN 5 THEN 'no_ai_ml_signal' WHEN 7 THEN NULL WHEN 8 THEN NULL WHEN 10 THEN 'score_below_threshold' ELSE why END AS reason_out,
 list_filter([CASE WHEN accessible = 'doctorate_required' THEN 'doctorate_required' END, CASE WHEN {_any('level', p.low_levels)} THEN 'bac3_4' END, CASE WHEN coalesce(unavailable, false) THEN 'expired_or_unavailable' END, CASE WHEN rule = 3 THEN 'postdoc' END], lambda v: v IS NOT NULL) AS flags FROM c)"""


@query("WITH " + _scored("offers") + " SELECT url, len(strong_hits) AS strong, len(adjacent_hits) AS adjacent, negative_hit, thesis, target_type, accessible AS accessibility, why AS eligibility, domain, score FROM s")
def score_components(spark, d) -> DataFrame:
    """The parts of the score of every offer."""
    e = F.col("eligibility")
    return C.scored(table(spark, d, "offers"), PACK).select(
        "url", F.size("strong_hits").alias("strong"), F.size("adjacent_hits").alias("adjacent"), "negative_hit", "thesis", e["target_type"].alias("target_type"), e["accessibility"].alias("accessibility"), e["reason"].alias("eligibility"), "domain", "score"
    )


_TEXTS = """CASE WHEN bucket = 'exclude' THEN 'Left out: ' || reason_out || '.' WHEN len(strong_hits) > 0 THEN CASE WHEN target_type <> 'not_target' THEN 'contract and level fit' ELSE 'contract or level to check' END || '; topics: ' || array_to_string(strong_hits[1:4], ', ') || '.'
 WHEN len(adjacent_hits) > 0 THEN 'Related field (' || array_to_string(adjacent_hits[1:3], ', ') || '), to check.' ELSE 'No topic found.' END AS reason,
 coalesce(nullif(contract_type, ''), 'n/a') || ', ' || bucket || ' for ' || domain || '.' AS summary,
 CASE bucket WHEN 'exclude' THEN 'Nothing to do: ' || reason_out || '.' WHEN 'adjacent_review' THEN 'To read: ' || domain || ', ' || printf('%.2f', score) || '.'
 ELSE CASE bucket WHEN 'primary_target' THEN 'First: ' ELSE 'Second: ' END || coalesce(nullif(contract_type, ''), 'n/a') || ' ' || coalesce(nullif(education_level, ''), 'n/a') || ', ' || domain || ', ' || printf('%.2f', score) || '.' END AS interest"""


@query("WITH " + _decided("offers") + f" SELECT url, bucket, bucket <> 'exclude' AS is_target, target_type <> 'not_target' AS passed, domain, accessible AS accessibility, reason_out AS exclusion_reason, array_to_string(flags, ',') AS flags, score, 'pack-1' AS version, {_TEXTS} FROM d")
def classify_offers(spark, d) -> DataFrame:
    """The outcome of all rules, written over the stored columns."""
    rows = C.applied(table(spark, d, "offers"), PACK, F.lit("2030-01-01").cast("timestamp"))
    return rows.select(
        "url", F.col("target_bucket").alias("bucket"), "is_target", F.col("hard_filter_passed").alias("passed"), F.col("ai_category").alias("domain"), "accessibility", "exclusion_reason", F.array_join("risk_flags", ",").alias("flags"),
        F.col("ai_relevance_score").alias("score"), F.col("classifier_version").alias("version"), F.col("ai_reason").alias("reason"), F.col("short_summary").alias("summary"), F.col("why_interesting").alias("interest"),
    )


_CASES = "cases AS (SELECT item_id, expected_bucket, expected_ai_domain, expected_accessibility, reference AS url, 'cnrs' AS source, title, CAST(NULL AS VARCHAR) AS contract_type, CAST(NULL AS VARCHAR) AS education_level, text AS description, CAST(NULL AS VARCHAR) AS skills, '' AS raw_text, false AS unavailable FROM eval_items)"


def _cases(spark, d) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = table(spark, d, "eval_items").select(
        "item_id", "expected_bucket", "expected_ai_domain", "expected_accessibility", F.col("reference").alias("url"), F.lit("cnrs").alias("source"), "title", none.alias("contract_type"), none.alias("education_level"),
        F.col("text").alias("description"), none.alias("skills"), F.lit("").alias("raw_text"), F.lit(False).alias("unavailable"),
    )
    return C.classified(rows, PACK)


_RATIO = "CASE WHEN {d} = 0 THEN 0.0 ELSE round_even({n}::DOUBLE / {d}, 3) END AS {a}"
_COUNTED = f"""WITH {_CASES}, {_decided('cases')},
m AS (SELECT count(*) AS total, count(*) FILTER (WHERE bucket = expected_bucket) AS buckets, count(*) FILTER (WHERE domain = expected_ai_domain) AS domains, count(*) FILTER (WHERE accessible = expected_accessibility) AS access,
 count(*) FILTER (WHERE bucket <> 'exclude' AND expected_bucket <> 'exclude') AS both_target, count(*) FILTER (WHERE bucket <> 'exclude') AS found, count(*) FILTER (WHERE expected_bucket <> 'exclude') AS wanted FROM d)"""
_METRICS = ", ".join(_RATIO.format(n=n, d=d, a=a) for n, d, a in (("buckets", "total", "bucket_accuracy"), ("domains", "total", "domain_accuracy"), ("access", "total", "accessibility_accuracy"), ("both_target", "found", "target_precision"), ("both_target", "wanted", "target_recall")))


@query(f"{_COUNTED} SELECT total, {_METRICS}, found - both_target AS false_targets, wanted - both_target AS missed_targets FROM m")
def eval_accuracy(spark, d) -> DataFrame:
    """Bucket, domain and accessibility accuracy, target precision and recall of the pack on the labelled cases, in one pass."""
    c = F.col("cls")
    found, expected = c["target_bucket"] != "exclude", F.col("expected_bucket") != "exclude"
    m = _cases(spark, d).agg(
        F.count("*").alias("total"), F.count_if(c["target_bucket"] == F.col("expected_bucket")).alias("buckets"), F.count_if(c["ai_domain"] == F.col("expected_ai_domain")).alias("domains"),
        F.count_if(c["accessibility"] == F.col("expected_accessibility")).alias("access"), F.count_if(found & expected).alias("both"), F.count_if(found).alias("found"), F.count_if(expected).alias("wanted"),
    )
    x = F.col
    return m.select(
        "total", safe_ratio(x("buckets"), x("total")).alias("bucket_accuracy"), safe_ratio(x("domains"), x("total")).alias("domain_accuracy"), safe_ratio(x("access"), x("total")).alias("accessibility_accuracy"),
        safe_ratio(x("both"), x("found")).alias("target_precision"), safe_ratio(x("both"), x("wanted")).alias("target_recall"), (x("found") - x("both")).alias("false_targets"), (x("wanted") - x("both")).alias("missed_targets"),
    )


EVAL_GATES = {"cases": "total >= 20", "bucket_accuracy": "bucket_accuracy >= 0.3", "no_false_targets": "false_targets = 0", "no_missed_targets": "missed_targets = 0"}


@query(f"WITH a AS ({_COUNTED} SELECT total, {_METRICS}, found - both_target AS false_targets, wanted - both_target AS missed_targets FROM m) " + " UNION ALL ".join(f"SELECT '{k}' AS gate, {e} AS passed FROM a" for k, e in EVAL_GATES.items()))
def eval_gate(spark, d) -> DataFrame:
    """Whether the pack is good enough: enough cases, accuracy, no false and no missed target."""
    return eval_accuracy(spark, d).selectExpr(f"stack({len(EVAL_GATES)}, " + ", ".join(f"'{k}', {e}" for k, e in EVAL_GATES.items()) + ") AS (gate, passed)")


_SPECIFIC = ", ".join(f"'{k}=' || json_extract_string(source_specific, '$.{k}')" for k in C.SPECIFIC_KEYS)


@query("WITH " + _scored("offers") + f""" SELECT url, content_hash, CASE WHEN source = 'anrt' THEN concat_ws(' ', 'member portal', CASE json_extract_string(source_specific, '$.anrt_kind') WHEN 'entreprise' THEN 'company side' WHEN 'laboratoire' THEN 'laboratory side' END)
WHEN source = 'cnrs' THEN 'public research jobs' ELSE source END AS context, array_to_string(list_filter([{_SPECIFIC}], lambda v: v IS NOT NULL), ';') AS specific, substring(raw_text, 1, 4000) AS excerpt, title FROM s
WHERE target_type <> 'not_target' OR domain <> 'not_relevant'""")
def llm_requests(spark, d) -> DataFrame:
    """What a provider would be sent for the offers that pass the gate: context, allowed fields, excerpt."""
    rows = C.scored(table(spark, d, "offers"), PACK).filter(C.wanted(F.col("eligibility.target_type"), F.col("domain")))
    kind = F.get_json_object("source_specific", "$.anrt_kind")
    pairs = F.array_sort(F.transform(F.map_entries(C.specific_fields(F.col("source_specific"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    body = F.from_json(F.col("request"), "title string, raw_text_excerpt string")
    sent = rows.select("url", "content_hash", C.source_context(F.col("source"), kind).alias("context"), F.array_join(pairs, ";").alias("specific"), F.to_json(F.struct("title", F.substring("raw_text", 1, 4000).alias("raw_text_excerpt"))).alias("request"))
    return sent.select("url", "content_hash", "context", "specific", body["raw_text_excerpt"].alias("excerpt"), body["title"].alias("title"))


@query(" UNION ALL ".join("SELECT '{}' AS rule, count(*) AS rows FROM offers WHERE NOT coalesce({}, false)".format(k, e) for k, e in OFFER_RULES.items()))
def schema_violations(spark, d) -> DataFrame:
    """Rows that break each rule of the schema: required values, enumerations, ranges."""
    broken = table(spark, d, "offers").select(F.explode(broken_rules()).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    rules = table(spark, d, "offers").sparkSession.createDataFrame([(k,) for k in OFFER_RULES], "rule string")
    return rules.join(broken, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("rows"))

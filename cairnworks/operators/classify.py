"""Rule classification as struct-valued cascades over a pack of data, and the overlay of an external classifier.

A pack holds terms, labels, thresholds and wordings; the operators know their order only. Everything is native
expressions in a few projections, so the text of a row is lowered once. Null and empty fields count as missing; a
condition that is null does not hold; ties are settled by the declared order of terms and rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnworks.functions.rules import Dictionary, assembled_text, capped_score, cascade
from cairnworks.functions.text import blank_to_null
from cairnworks.operators.state import cache_lookup, cache_put


def struct_cascade(names: list[str], rules: list[tuple[Column, list[Column]]], otherwise: list[Column]) -> Column:
    """The struct of the first rule that holds."""
    row = lambda values: F.struct(*[v.alias(n) for n, v in zip(names, values)])
    return cascade([(condition, row(values)) for condition, values in rules], row(otherwise))


def flag_list(flags: list[tuple[Column, str]]) -> Column:
    """The names of all conditions that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in flags]), lambda x: x.isNotNull())


def any_term(text: Column, terms: tuple[str, ...]) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)), F.lit(False))


def first_term(text: Column, terms: tuple[str, ...]) -> Column:
    """The first term in declared order that the text holds, else null."""
    return F.get(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)), 0)


@dataclass(frozen=True)
class Pack:
    """The data of a classification. Terms are in lower case; labels are the dictionaries'."""

    version: str
    strong: Dictionary
    adjacent: Dictionary
    negative: tuple[str, ...]
    special: tuple[str, ...]  # labels of strong terms that make the special domain
    barred: tuple[str, ...]  # contracts
    too_high: tuple[str, ...]  # anywhere in the text: the level asked for is too high
    too_high_named: tuple[str, ...]  # in title, contract, level and url
    thesis_contracts: tuple[str, ...]
    thesis_titles: tuple[str, ...]
    thesis_path: str
    open_levels: tuple[str, ...]
    fixed_term: str
    engineers: tuple[str, ...]
    low_levels: tuple[str, ...]
    weights: dict[str, tuple[int, int]] = field(default_factory=lambda: {"hard": (25, 25), "strong": (14, 56), "adjacent": (6, 18), "thesis": (8, 8), "negative": (-25, -25)})
    near_score: float = 0.18
    least_score: float = 0.35


RESULT = ["target_bucket", "is_target", "exclusion_reason"]


def scored(df: DataFrame, pack: Pack) -> DataFrame:
    """df with the parts of the score: t, contract, level, hits, thesis, eligibility, domain, score."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    texts = df.withColumns({"t": assembled_text("title", "contract_type", "education_level", body=("description", "skills"), fallback="raw_text"), "contract": low("contract_type"), "level": low("education_level")})
    named = F.lower(F.concat_ws(" ", *[blank_to_null(F.col(c)) for c in ("title", "contract_type", "education_level", "url")]))
    hits = texts.withColumns({
        "strong_hits": pack.strong.labels(F.col("t")), "adjacent_hits": pack.adjacent.labels(F.col("t")), "negative_hit": first_term(F.col("t"), pack.negative), "barred": first_term(F.col("contract"), pack.barred),
        "thesis": any_term(F.col("contract"), pack.thesis_contracts) | any_term(F.lower("title"), pack.thesis_titles) | F.contains(F.lower("url"), F.lit(pack.thesis_path)),
        "too_high": any_term(F.col("t"), pack.too_high) | any_term(named, pack.too_high_named),
    })
    none, text = F.lit(None).cast("string"), lambda x: F.lit(x)
    open_level = any_term(F.col("level"), pack.open_levels)
    fixed = F.contains("contract", F.lit(pack.fixed_term)) & (any_term(F.col("contract"), pack.engineers) | any_term(F.col("t"), pack.engineers)) & (open_level | any_term(F.col("t"), pack.open_levels))
    eligibility = struct_cascade(["passed", "target_type", "accessibility", "reason"], [
        (F.col("barred").isNotNull(), [F.lit(False), text("not_target"), text("not_accessible"), F.concat(F.lit("excluded_contract:"), "barred")]),
        (F.col("too_high"), [F.lit(False), text("not_target"), text("doctorate_required"), text("doctorate_required")]),
        ((F.col("source") == "anrt") & F.contains("contract", F.lit("cifre")), [F.lit(True), text("thesis_or_bac5_cdd"), text("bac5_accessible"), none]),
        (F.col("thesis"), [F.lit(True), text("thesis_or_bac5_cdd"), F.when(open_level | F.contains("contract", F.lit("doctorant")), "bac5_accessible").otherwise("unclear"), none]),
        (fixed, [F.lit(True), text("bac5_cdd"), text("bac5_accessible"), none]),
    ], [F.lit(False), text("not_target"), text("unclear"), text("not_contract_or_level_target")])
    special = F.arrays_overlap("strong_hits", F.array(*map(F.lit, pack.special)))
    domain = cascade([(F.col("negative_hit").isNotNull(), "not_relevant"), (special, "generative_ai"), (F.size("strong_hits") > 0, "ml_deep_learning"), (F.size("adjacent_hits") > 0, "data_science_adjacent")], "not_relevant")
    counts = {"hard": F.col("eligibility.passed").cast("int"), "strong": F.size("strong_hits"), "adjacent": F.size("adjacent_hits"), "thesis": F.col("thesis").cast("int"), "negative": F.col("negative_hit").isNotNull().cast("int")}
    return hits.withColumns({"eligibility": eligibility, "domain": domain}).withColumn("score", capped_score([(counts[k], *pack.weights[k]) for k in counts]))


def classified(df: DataFrame, pack: Pack) -> DataFrame:
    """df with a struct `cls`: the outcome of all rules."""
    x = scored(df, pack)
    e, domain, score, none = F.col("eligibility"), F.col("domain"), F.col("score"), F.lit(None).cast("string")
    out = lambda reason: [F.lit("exclude"), F.lit(False), reason]
    target = lambda bucket, reason=none: [F.lit(bucket), F.lit(True), reason]
    gone, thesis = F.coalesce("unavailable", F.lit(False)), e["target_type"] == "thesis_or_bac5_cdd"
    near = domain == "data_science_adjacent"
    decided = struct_cascade(RESULT, [
        (gone, out(F.lit("expired_or_unavailable"))),
        (e["reason"].startswith("excluded_contract:"), out(e["reason"])),
        (e["accessibility"] == "doctorate_required", out(F.lit("doctorate_required_or_postdoc"))),
        (F.col("negative_hit").isNotNull(), out(F.concat(F.lit("negative_signal:"), "negative_hit"))),
        (domain == "not_relevant", out(F.lit("no_ai_ml_signal"))),
        ((F.col("source") == "anrt") & thesis & near, target("adjacent_review", e["reason"])),
        (thesis, target("primary_target")),
        (e["target_type"] == "bac5_cdd", target("secondary_target")),
        (near & (score >= pack.near_score), target("adjacent_review", e["reason"])),
        (score < pack.least_score, out(F.lit("score_below_threshold"))),
        (domain.isin("ml_deep_learning", "generative_ai"), target("adjacent_review", e["reason"])),
    ], out(F.coalesce(e["reason"], F.lit("not_target"))))
    high = e["accessibility"] == "doctorate_required"
    flags = flag_list([(high, "doctorate_required"), (any_term(F.col("level"), pack.low_levels), "bac3_4"), (gone, "expired_or_unavailable"), (high & ~gone & ~F.coalesce(e["reason"].startswith("excluded_contract:"), F.lit(False)), "postdoc")])
    x = x.withColumns({"decided": decided, "risk_flags_": flags})
    d, named = F.col("decided"), lambda c: F.coalesce(blank_to_null(F.col(c)), F.lit("n/a"))
    listed = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    reason = F.coalesce(
        F.when((d["target_bucket"] == "exclude") & d["exclusion_reason"].isNotNull(), F.format_string("Left out: %s.", d["exclusion_reason"])),
        F.when(F.size("strong_hits") > 0, F.format_string("%s; topics: %s.", F.when(e["passed"], "contract and level fit").otherwise("contract or level to check"), listed("strong_hits", 4))),
        F.when(F.size("adjacent_hits") > 0, F.format_string("Related field (%s), to check.", listed("adjacent_hits", 3))), F.lit("No topic found."),
    )
    summary = F.format_string("%s, %s for %s.", named("contract_type"), d["target_bucket"], domain)
    interest = cascade([
        (d["target_bucket"] == "exclude", F.format_string("Nothing to do: %s.", F.coalesce(d["exclusion_reason"], F.lit("out of scope")))),
        (d["target_bucket"] == "primary_target", F.format_string("First: %s %s, %s, %.2f.", named("contract_type"), named("education_level"), domain, score)),
        (d["target_bucket"] == "secondary_target", F.format_string("Second: %s %s, %s, %.2f.", named("contract_type"), named("education_level"), domain, score)),
    ], F.format_string("To read: %s, %.2f.", domain, score))
    cls = F.struct(
        d["is_target"].alias("is_target"), e["target_type"].alias("target_type"), domain.alias("ai_domain"), d["target_bucket"].alias("target_bucket"), score.alias("relevance_score"), e["accessibility"].alias("accessibility"),
        d["exclusion_reason"].alias("exclusion_reason"), summary.alias("short_summary"), interest.alias("why_interesting"), F.col("risk_flags_").alias("risk_flags"), F.lit(pack.version).alias("classifier_version"), reason.alias("reason"),
    )
    return x.withColumn("cls", cls).select(*df.columns, "cls")


def applied(df: DataFrame, pack: Pack, now: Column) -> DataFrame:
    """df with the outcome written over its stored columns."""
    c = F.col("cls")
    columns = {
        "hard_filter_passed": c["target_type"] != "not_target", "ai_relevance_score": c["relevance_score"], "ai_category": c["ai_domain"], "ai_reason": c["reason"], "last_classified_at": now,
        **{k: c[k] for k in ("is_target", "target_bucket", "accessibility", "exclusion_reason", "short_summary", "why_interesting", "risk_flags", "classifier_version")},
    }
    return classified(df, pack).withColumns(columns).drop("cls")


# --- the external classifier -------------------------------------------------------------------------------

CATEGORIES = ("ml_deep_learning", "generative_ai", "general_ai", "data_science_adjacent", "not_relevant")
BUCKETS = ("primary_target", "secondary_target", "adjacent_review", "exclude")
ACCESS = ("bac5_accessible", "doctorate_required", "unclear", "not_accessible")
ANSWER = "is_target boolean, target_bucket string, ai_domain string, accessibility string, relevance_score double, short_summary string, reason string, risk_flags array<string>"
ANSWER_KEYS = tuple(x.split()[0] for x in ANSWER.split(", "))
SPECIFIC_KEYS = ("anrt_kind", "application_deadline", "cifre_status", "company_name", "contact_visible", "discipline", "doctoral_school", "funding_status", "laboratory_name", "partner_expected", "remote_or_hybrid", "sector")


def wanted(target_type: Column, domain: Column) -> Column:
    """The gate: whether a row is worth a call."""
    return (target_type != "not_target") | (domain != "not_relevant")


def specific_fields(source_specific: Column, keys: tuple[str, ...] = SPECIFIC_KEYS) -> Column:
    """The allowed keys with a value, as a map."""
    held = F.from_json(source_specific, "map<string,string>")
    return F.map_filter(F.coalesce(held, F.expr("cast(map() AS map<string,string>)")), lambda k, v: k.isin(*keys) & v.isNotNull())


def source_context(source: Column, kind: Column) -> Column:
    return F.when(source == "anrt", F.concat_ws(" ", F.lit("member portal"), F.when(kind == "entreprise", "company side").when(kind == "laboratoire", "laboratory side"))).when(source == "cnrs", "public research jobs").otherwise(source)


def requests(df: DataFrame, excerpt: int = 4000) -> DataFrame:
    """(content_hash, request): the fields a provider gets, as JSON; the excerpt bounds what is sent, the text itself stays whole."""
    kind = F.get_json_object("source_specific", "$.anrt_kind")
    fields = ["source", "title", "contract_type", "duration", "education_level", "experience_level", "location", "lab", "description", "skills"]
    body = F.struct(*fields, source_context(F.col("source"), kind).alias("source_context"), specific_fields(F.col("source_specific")).alias("source_specific"), F.substring("raw_text", 1, excerpt).alias("raw_text_excerpt"))
    return df.select("content_hash", F.to_json(body).alias("request"))


def provider_answers(rows: DataFrame, provider: Callable[[str], str]) -> DataFrame:
    """(content_hash, response_json, error) of each request, called in Arrow batches; an error becomes a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = [], []
            for request in batch.column(1).to_pylist():
                try:
                    answers.append(provider(request))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["content_hash", "response_json", "error"])

    return rows.select("content_hash", "request").mapInArrow(run, "content_hash string, response_json string, error string")


def valid_answer(response: Column, required: tuple[str, ...] = ANSWER_KEYS) -> Column:
    """All required keys and no unknown one, values of the right type, within their enumerations and range."""
    keys, x = F.json_object_keys(response), F.from_json(response, ANSWER)
    checks = [
        F.size(F.array_except(F.array(*map(F.lit, required)), keys)) == 0, F.size(F.array_except(keys, F.array(*map(F.lit, ANSWER_KEYS)))) == 0, F.size(keys) == F.size(F.array_distinct(keys)),
        x["relevance_score"].between(0, 1), x["target_bucket"].isin(*BUCKETS), x["ai_domain"].isNull() | x["ai_domain"].isin(*CATEGORIES), x["accessibility"].isNull() | x["accessibility"].isin(*ACCESS),
        *[x[k].isNotNull() for k in required], ~F.exists(F.coalesce(x["risk_flags"], F.array()), lambda v: v.isNull()),
    ]
    out = F.lit(True)
    for c in checks:
        out = out & c
    return F.coalesce(out, F.lit(False))


INVALID_FLAG = "llm_invalid_response"


def overlay(df: DataFrame, response: str, version: str, required: tuple[str, ...] = ANSWER_KEYS) -> DataFrame:
    """Rows with the answer in column `response` laid over the stored outcome, and a column `answered`: none, valid, invalid.

    A valid answer replaces what it holds; an invalid one sends a target to review and adds a flag; without one the row stays.
    """
    valid = valid_answer(F.col(response), required)
    x = df.withColumns({"answered": F.when(F.col(response).isNull(), "none").when(valid, "valid").otherwise("invalid"), "x": F.from_json(response, ANSWER)})
    good, bad, a = F.col("answered") == "valid", F.col("answered") == "invalid", F.col("x")
    taken = lambda key, column: F.when(good & a[key].isNotNull(), a[key])
    flags = F.coalesce("risk_flags", F.expr("cast(array() AS array<string>)"))
    columns = {
        "target_bucket": taken("target_bucket", 0).when(bad & F.col("is_target"), "adjacent_review").otherwise(F.col("target_bucket")), "is_target": taken("is_target", 0).otherwise(F.col("is_target")),
        "accessibility": taken("accessibility", 0).otherwise(F.col("accessibility")), "ai_relevance_score": taken("relevance_score", 0).otherwise(F.col("ai_relevance_score")), "ai_category": taken("ai_domain", 0).otherwise(F.col("ai_category")),
        "ai_reason": taken("reason", 0).when(bad, "The answer was invalid; the rules stand, to review.").otherwise(F.col("ai_reason")), "short_summary": taken("short_summary", 0).otherwise(F.col("short_summary")), "why_interesting": taken("reason", 0).otherwise(F.col("why_interesting")),
        "risk_flags": taken("risk_flags", 0).when(bad, F.array_sort(F.array_union(flags, F.array(F.lit(INVALID_FLAG))))).otherwise(F.col("risk_flags")), "classifier_version": F.when(good, version).otherwise(F.col("classifier_version")),
    }
    return x.withColumns(columns).drop("x")


def classified_with_provider(df: DataFrame, pack: Pack, now: Column, cache: DataFrame, version: str, provider: Callable[[str], str] | None, mode: str = "hybrid") -> tuple[DataFrame, DataFrame]:
    """(rows, cache): rules first; rows that pass the gate and have a hash are answered from the cache or by the provider.

    mode `rules`, or no provider, gives the rules alone. Each hash is asked for once; valid answers are kept in the cache.
    """
    ruled = applied(df, pack, now)
    if mode == "rules" or provider is None:
        return ruled, cache
    gate = wanted(F.when(F.col("hard_filter_passed"), "target").otherwise("not_target"), F.col("ai_category")) & F.col("content_hash").isNotNull()
    asked = ruled.filter(gate).dropDuplicates(["content_hash"])
    _, misses = cache_lookup(asked, cache, version)
    fresh = provider_answers(requests(misses), provider).withColumn("classifier_version", F.lit(version))
    kept = cache_put(cache, fresh, valid_answer(F.col("response_json")), now)
    held = cache.filter(F.col("classifier_version") == version).select("content_hash", "response_json").unionByName(fresh.select("content_hash", F.coalesce("response_json", F.lit("")).alias("response_json")))
    answers = held.groupBy("content_hash").agg(F.min("response_json").alias("response_json"))
    joined = ruled.join(answers, "content_hash", "left").withColumn("response_json", F.when(gate, F.col("response_json")))
    return overlay(joined, "response_json", version).select(*ruled.columns), kept

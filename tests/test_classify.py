import json
from datetime import datetime as dt

from pyspark.sql import functions as F

from cairnworks import schemas as S
from cairnworks.operators import classify as C
from cairnworks.plans.classifying import PACK
from cairnworks.sources import sinks as K

NOW = dt(2026, 1, 1)


def offers(spark, *rows):
    """Rows of the offers table from what is given, the rest null."""
    names = [x.split()[0] for x in S.OFFERS.split(", ")]
    base = {"source": "cnrs", "raw_text": "", "title": "T", "last_seen_status": "seen", "unavailable": False}
    return spark.createDataFrame([tuple(({"url": f"u{i}"} | base | r).get(n) for n in names) for i, r in enumerate(rows)], S.OFFERS)


def outcome(spark, *rows):
    got = C.classified(offers(spark, *rows), PACK).orderBy("url").collect()
    return [r["cls"] for r in got]


def test_cascade_in_order(spark):
    strong = "deep learning and computer vision"
    got = outcome(
        spark,
        {"unavailable": True, "contract_type": "Stage", "description": strong}, {"contract_type": "Stage", "description": strong}, {"contract_type": "CDD doctorant", "description": strong + " PhD required"},
        {"contract_type": "CDD doctorant", "description": strong + " remote sensing"}, {"contract_type": "CDD doctorant", "description": "cooking"}, {"source": "anrt", "contract_type": "CIFRE", "description": "graph mining"},
        {"contract_type": "CDD doctorant", "description": "graph mining"}, {"contract_type": "CDD", "education_level": "Bac+5", "title": "Engineer", "description": strong}, {"contract_type": "CDD", "description": "graph mining, bayesian data and optimisation: données"},
    )
    got += outcome(spark, {"contract_type": "CDD", "description": "deep learning"}, {"contract_type": "CDD", "description": "transformer, deep learning, computer vision"}, {"title": "Thèse", "education_level": None, "description": "deep learning"})
    assert [(c["target_bucket"], c["exclusion_reason"]) for c in got] == [
        ("exclude", "expired_or_unavailable"), ("exclude", "excluded_contract:stage"), ("exclude", "doctorate_required_or_postdoc"), ("exclude", "negative_signal:remote sensing"), ("exclude", "no_ai_ml_signal"), ("adjacent_review", None),
        ("primary_target", None), ("secondary_target", None), ("adjacent_review", "not_contract_or_level_target"), ("exclude", "score_below_threshold"), ("adjacent_review", "not_contract_or_level_target"), ("primary_target", None),
    ]
    assert got[2]["risk_flags"] == ["doctorate_required", "postdoc"] and got[0]["risk_flags"] == ["expired_or_unavailable"] and got[10]["ai_domain"] == "generative_ai" and got[11]["accessibility"] == "unclear"
    assert got[11]["reason"] == "contract and level fit; topics: deep learning." and got[7]["why_interesting"] == "Second: CDD Bac+5, ml_deep_learning, 0.53." and got[4]["short_summary"] == "CDD doctorant, exclude for not_relevant."


def test_null_and_empty_fields(spark):
    got = outcome(spark, {"title": "", "raw_text": "DEEP LEARNING"}, {"description": "", "skills": None, "raw_text": "deep learning " * 50_000}, {"unavailable": None})
    assert [c["ai_domain"] for c in got] == ["ml_deep_learning", "ml_deep_learning", "not_relevant"]
    assert C.classified(offers(spark), PACK).count() == 0
    clash = offers(spark, {"description": "deep learning"}).withColumns({"cls_": F.lit(1), "key": F.lit("x")})
    assert {"cls_", "key"} <= set(C.applied(clash, PACK, F.lit(NOW)).columns)


GOOD = {"is_target": True, "target_bucket": "secondary_target", "ai_domain": "general_ai", "accessibility": "unclear", "relevance_score": 0.5, "short_summary": "s", "reason": "r", "risk_flags": ["b", "a"]}


def test_strict_validation(spark):
    bad = [
        {k: v for k, v in GOOD.items() if k != "reason"}, GOOD | {"extra": 1}, GOOD | {"target_bucket": "x"}, GOOD | {"relevance_score": 1.5}, GOOD | {"relevance_score": "0.5"}, GOOD | {"is_target": "true"}, GOOD | {"risk_flags": None}, GOOD | {"ai_domain": "x"}, [], "text",
    ]
    rows = [(json.dumps(x),) for x in (GOOD, GOOD | {"relevance_score": 1}, GOOD | {"risk_flags": []}, *bad)] + [("{bad",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "r string").select(C.valid_answer(F.col("r"))).collect()]
    assert got == [True] * 3 + [False] * (len(rows) - 3)


def test_overlay(spark):
    df = offers(spark, {"is_target": True, "target_bucket": "primary_target", "risk_flags": ["z"]}, {"is_target": False, "target_bucket": "exclude"}, {"is_target": True, "target_bucket": "primary_target"}, {"is_target": True, "target_bucket": "primary_target"})
    answers = spark.createDataFrame([("u0", "{bad"), ("u1", "{bad"), ("u2", json.dumps(GOOD)), ("u3", None)], "url string, answer string")
    got = {r["url"]: r for r in C.overlay(df.join(answers, "url"), "answer", "v9").collect()}
    assert (got["u0"]["target_bucket"], got["u0"]["risk_flags"], got["u0"]["answered"]) == ("adjacent_review", ["llm_invalid_response", "z"], "invalid")
    assert (got["u1"]["target_bucket"], got["u1"]["risk_flags"]) == ("exclude", ["llm_invalid_response"]) and got["u3"]["target_bucket"] == "primary_target"
    assert (got["u2"]["target_bucket"], got["u2"]["ai_category"], got["u2"]["risk_flags"], got["u2"]["classifier_version"], got["u2"]["why_interesting"]) == ("secondary_target", "general_ai", ["b", "a"], "v9", "r")


def test_provider_is_asked_once_per_hash_behind_the_gate(spark):
    answer, text = json.dumps(GOOD), "deep learning"

    def provider(request):
        body = json.loads(request)
        if body["title"] == "fails":
            raise OSError("no answer")
        return answer if body["raw_text_excerpt"] == "" and "source_context" in body else "{bad"

    rows = [{"title": "A", "content_hash": "h1", "description": text}, {"title": "A", "content_hash": "h1", "description": text}, {"title": "fails", "content_hash": "h2", "description": text}, {"title": "C", "content_hash": "h3", "description": "cooking"}, {"title": "D", "content_hash": None, "description": text},
            {"title": "E", "content_hash": "h5", "description": text, "raw_text": "x"}, {"title": "F", "content_hash": "h6", "description": text}]
    cache = spark.createDataFrame([("h6", "v", json.dumps(GOOD | {"target_bucket": "primary_target"}), NOW)], S.CACHE)
    got, kept = C.classified_with_provider(offers(spark, *rows), PACK, F.lit(NOW), cache, "v", provider)
    by = {r["url"]: r for r in got.collect()}
    assert [by[f"u{i}"]["target_bucket"] for i in (0, 1, 6)] == ["secondary_target", "secondary_target", "primary_target"] and by["u3"]["classifier_version"] == by["u4"]["classifier_version"] == "pack-1"
    assert "llm_invalid_response" in by["u2"]["risk_flags"] and "llm_invalid_response" in by["u5"]["risk_flags"]
    assert sorted(r["content_hash"] for r in kept.collect()) == ["h1", "h6"]
    rules, same = C.classified_with_provider(offers(spark, *rows), PACK, F.lit(NOW), cache, "v", None)
    assert {r["classifier_version"] for r in rules.collect()} == {"pack-1"} and same is cache


def test_quarantine(spark):
    df = offers(spark, {"target_bucket": "primary_target", "ai_relevance_score": 0.2}, {"target_bucket": "x", "ai_relevance_score": 1.2}, {"title": None}, {"first_seen_at": NOW, "last_seen_at": dt(2025, 1, 1)})
    good, bad = S.quarantined(df)
    assert [r["url"] for r in good.collect()] == ["u0"] and {r["url"]: r["broken"] for r in bad.collect()} == {"u1": ["target_bucket unknown", "score out of range"], "u2": ["title missing"], "u3": ["seen backwards"]}


def test_digest_entries_and_seeds(spark):
    specific = json.dumps({"company_name": "ACME", "contact_visible": True, "sector": "", "note": "call 06 11 22 33 44"})
    row = offers(spark, {"source": "anrt", "title": "T", "source_specific": specific, "ai_relevance_score": 0.5, "raw_text": "a@b.example", "risk_flags": ["x", "y"]}, {"source": "cnrs", "source_specific": "{bad"})
    a, b = (r[0].split("\n") for r in row.orderBy("url").select(K.offer_block(K.display_origin({"cnrs": "C"}, {}))).collect())
    assert a[:4] == ["### T", "", "- Source : anrt", "- Type : n/a"] and "- Entreprise : ACME" in a and "- Contact visible : oui" in a and not any("Secteur" in x for x in a) and "- Score : 0.50" in a and "- Flags : x, y" in a and a[-1] == "- Lien : u0"
    assert "- Source : C" in b and "- Flags : aucun" in b and "- Score : n/a" in b and len(b) == 15
    seed = row.orderBy("url").select(K.seed_case().alias("s")).first()["s"]
    assert seed["offer"]["source_specific"]["note"] == "call 00 00 00 00 00" and seed["offer"]["raw_text"] == "contact@example.invalid" and seed["reference"] == "u0" and seed["expected_ai_domain"] == "not_relevant" and "sector" not in seed["offer"]["source_specific"]


def test_page_audit_and_tree(spark, tmp_path):
    pages = spark.createDataFrame([("a", "list", "x"), ("one", "detail", "call +33 (0)5 36 49 20 65"), ("two", "detail", "fine")], "name string, part string, payload string")
    listed = spark.createDataFrame([("one",), ("two",), ("three",), ("three",)], "name string")
    r = K.page_audit(pages, listed, ["a", "b"]).first()
    assert (r["lists"], r["details"], r["absent_lists"], r["leaking"], r["listed"], r["absent_details"], r["ok"]) == (1, 2, ["b"], 1, 3, 1, False)
    tree = spark.createDataFrame([("file:/data/pages/list/a.html", "mail x@y.org"), ("file:/data/pages/detail/b.html", None)], "path string, payload string")
    assert K.write_anonymised_tree(tree, "data/pages", str(tmp_path / "out")) == 2
    assert (tmp_path / "out/list/a.html").read_text() == "mail contact@example.invalid" and (tmp_path / "out/detail/b.html").read_text() == ""


def test_reports(spark):
    audit = spark.createDataFrame([("b", 2, None), ("a", 1, "x|y")], "kind string, pages int, note string")
    assert K.run_report("Run", {"found": 3, "latest": None}, audit) == "# Run\n\n- found : 3\n- latest : n/a\n\n| kind | pages | note |\n| --- | --- | --- |\n| a | 1 | x\\|y |\n| b | 2 | n/a |\n"
    assert json.loads(K.console(audit.orderBy("kind"), 1, as_json=True)) == {"kind": "a", "pages": 1, "note": "x|y"} and "kind" in K.console(audit, 1)
    gates = spark.range(1500).select(F.col("id").cast("string").alias("gate"), F.lit(True).alias("passed"), F.lit("d").alias("detail"))
    assert K.gate_table(gates).count("\n") == 1502

import pytest
from pyspark.sql import functions as F

from cairnworks.functions import text as T
from cairnworks.operators.extract import detail_rows
from cairnworks.sources import payloads as P
from cairnworks.sources import sinks as K


def test_retries():
    calls, slept = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise P.RetryableError
        return "ok"

    assert P.with_retries(flaky, sleep=slept.append)("u") == "ok" and slept == [1.0, 2.0]
    with pytest.raises(P.RetryableError):
        P.with_retries(lambda u: (_ for _ in ()).throw(P.RetryableError()), retries=1, sleep=slept.append)("u")


def test_session_cookies():
    assert P.session_cookies('[{"name":"a","value":"1"},{"name":"","value":"2"},{"name":"b","value":null}]') == {"a": "1"}
    assert P.session_cookies('{"cookies":[{"name":"a","value":""}]}') == {"a": ""}
    for bad in ("x", "{}", "[]", '[{"name":1,"value":2}]'):
        with pytest.raises(P.AuthError):
            P.session_cookies(bad)


def test_registry(spark):
    r = P.Registry(P.SourceDefinition("a", "A", False))
    assert r["a"].display_name == "A" and r.dimension(spark).count() == 1
    with pytest.raises(ValueError):
        r["b"]


def test_fetch_only_what_is_missing(spark):
    def fetch(url):
        if url == "bad":
            raise OSError("no")
        return "new " + url

    urls = spark.createDataFrame([("a",), ("b",), ("b",), ("bad",)], "url string")
    held = spark.createDataFrame([("a", "old a"), ("z", "old z")], "url string, payload string")
    got = sorted(tuple(r) for r in P.fetch_missing(urls, held, fetch, delay=0).collect())
    assert got == [("a", "old a", None), ("b", "new b", None), ("bad", None, "OSError: no")]


def test_folder_adapter_and_paginated_source(spark, tmp_path):
    (tmp_path / "detail").mkdir()
    (tmp_path / "detail" / "one.html").write_text("<h1>One</h1>")
    (tmp_path / "0.json").write_text('{"data":[]}')
    (tmp_path / "50.json").write_text('{"data":[1]}')
    files = P.read_files(spark, str(tmp_path)).collect()
    assert [(r["name"], r["payload"]) for r in files] == [("one", "<h1>One</h1>")]
    got = P.FolderAdapter(P.SourceDefinition("s", "S", False), str(tmp_path), detail_rows).run(spark).collect()
    assert [(r["title"], r["source"]) for r in got] == [("One", "s")]
    spark.dataSource.register(P.PaginatedJson)
    pages = spark.read.format("paginated_json").options(path=str(tmp_path), total="60", length="25")
    assert sorted(r["start"] for r in pages.option("missing", "skip").load().collect()) == [0, 50]
    with pytest.raises(Exception, match="25.json"):
        pages.option("missing", "fail").load().collect()
    assert {r["start"]: r["error"] for r in P.paged_files(spark, str(tmp_path), 60).collect()} == {0: None, 25: "page missing", 50: None}
    (tmp_path / "cases.json").write_text('[{"reference":"a"},{"reference":"b"}]')
    assert P.read_cases(spark, str(tmp_path / "cases.json"), "reference string").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b1", 2, "### B", None), ("b1", 1, "### A", "x")], "bucket string, position int, block string, note string")
    text = K.markdown("Digest", df, "bucket", ["b0", "b1"], {"b1": "Best"}, 10)
    assert text == "# Digest\n\n## Best\n\n### A\n\n### B\n"
    assert "Nothing" in K.markdown("Digest", df.filter("false"), "bucket", ["b1"], {}, 10)
    K.write_csv(df.orderBy("position"), str(tmp_path / "csv"), ["bucket", "note"])
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "csv")).fillna("").collect())) == [("b1", ""), ("b1", "x")]
    gates = spark.createDataFrame([("g", True, "a|b")], "gate string, passed boolean, detail string")
    assert "| g | yes | a\\|b |" in K.gate_table(gates)
    pages = spark.createDataFrame([("p", "mail me@x.org or 06 11 22 33 44")], "path string, payload string")
    assert K.write_anonymised(pages, str(tmp_path / "anon")).first()["written"] == 1
    assert spark.read.parquet(str(tmp_path / "anon")).first()["payload"] == f"mail {T.EMAIL_PLACEHOLDER} or {T.PHONE_PLACEHOLDER}"


def test_text_functions(spark):
    df = spark.createDataFrame([("  a   b\x1c\n",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(T.text_or_null(F.col("x"))).collect()] == ["a b", None, None]
    row = spark.createDataFrame([("contact@example.invalid", "/a/b//", "x", " 7 ")], "m string, p string, q string, n string").select(
        T.has_contact(F.col("m")), T.leaks_contact(F.col("m")), T.absolute_url(F.col("p"), "https://h"), T.absolute_url(F.col("q"), "https://h"), T.reference_of_url(F.col("p")), T.safe_int(F.col("n")), T.yes_no(F.lit(True))
    ).first()
    assert tuple(row) == (True, False, "https://h/a/b//", "https://h/x", "b", 7, "oui")
    assert [T.slug(x) for x in ("Thèse : Œuvre 12", "’", None)] == ["these-uvre-12", "snapshot", None]
    assert [r["slug"] for r in T.with_slug(spark.createDataFrame([("É a", 1)], "t string, n int"), "t").collect()] == ["e-a"]

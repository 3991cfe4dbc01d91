import shutil
from datetime import datetime as dt

from pyspark.sql import functions as F

from cairnworks.functions.rules import Dictionary, assembled_text, capped_score, cascade
from cairnworks.operators import state as S
from cairnworks.streaming.ingest import merge_stream, stream_rows

OFFERS = "url string, title string, first_seen_at timestamp, last_seen_at timestamp, last_seen_status string"
T1, T2, T3 = dt(2026, 1, 1), dt(2026, 1, 2), dt(2026, 1, 3)


def test_merge_keeps_first_seen_and_replaces_the_rest(spark):
    old = spark.createDataFrame([("a", "A", T1, T1, "missing"), ("b", "B", T1, T1, "seen")], OFFERS)
    new = spark.createDataFrame([("a", None, T2), ("c", "C", T2)], "url string, title string, first_seen_at timestamp")
    got = S.merge_by_key(old, new, "url", keep=["first_seen_at"], touch={"last_seen_at": F.lit(T3), "last_seen_status": F.lit("seen")})
    rows = sorted(tuple(r) for r in got.select("url", "title", "first_seen_at", "last_seen_at", "last_seen_status").collect())
    assert rows == [("a", None, T1, T3, "seen"), ("b", "B", T1, T1, "seen"), ("c", "C", T2, T3, "seen")]


def test_missing_only_for_a_complete_inventory(spark):
    df = spark.createDataFrame([("a", "A", T1, T1, "seen"), ("b", "B", T1, T1, "seen"), ("c", "C", T1, T1, "unavailable")], OFFERS)
    seen = spark.createDataFrame([("a",), ("a",)], "url string")
    live = F.col("last_seen_status") == "seen"
    got = {r["url"]: (r["last_seen_status"], r["last_seen_at"]) for r in S.mark_missing(df, seen, "url", within=live, now=F.lit(T3), complete=True).collect()}
    assert got == {"a": ("seen", T1), "b": ("missing", T3), "c": ("unavailable", T1)}
    assert S.mark_missing(df, seen, "url", within=live, now=F.lit(T3), complete=False) is df


def test_last_and_first_wins(spark):
    df = spark.createDataFrame([("k", 1, "x"), ("k", 3, "z"), ("j", 2, "y")], "key string, position int, v string")
    assert sorted((r["v"], r["first_position"]) for r in S.last_wins(df, F.col("key"), "position").collect()) == [("y", 2), ("z", 1)]
    assert sorted(r["v"] for r in S.first_wins(df, F.col("key"), "position").collect()) == ["x", "y"]


def test_defaults_migrate_additively(spark):
    df = S.with_defaults(spark.createDataFrame([("u", None)], "url string, source string"), {"source": F.lit("portal"), "flags": F.lit("[]")})
    assert tuple(df.first()) == ("u", None, "[]")


def test_cache_lookup(spark):
    rows = spark.createDataFrame([("h1",), ("h2",), (None,)], "content_hash string")
    cache = spark.createDataFrame([("h1", "v1", "{}"), ("h2", "v0", "{}")], "content_hash string, classifier_version string, response_json string")
    hit, miss = S.cache_lookup(rows, cache, "v1")
    assert [r[0] for r in hit.collect()] == ["h1"] and sorted(str(r[0]) for r in miss.collect()) == ["None", "h2"]


def test_versioned_table(spark, tmp_path):
    t = S.VersionedTable(spark, str(tmp_path / "offers"))
    assert t.read() is None
    assert t.write(spark.range(3)) == 1 and t.write(t.read().filter("id > 0")) == 2
    t.append(spark.range(10, 11))
    assert sorted(r[0] for r in t.read().collect()) == [1, 2, 10]


def test_appending_before_the_first_write_keeps_the_rows(spark, tmp_path):
    t = S.VersionedTable(spark, str(tmp_path / "log"))
    assert t.append(spark.range(2)) == 1 and t.append(spark.range(2, 3)) == 2
    assert sorted(r[0] for r in t.read().collect()) == [0, 1, 2]
    assert t.write(spark.range(9, 10)) == 3 and [r[0] for r in t.read().collect()] == [9]


def test_a_crash_before_the_commit_leaves_the_version_before(spark, tmp_path):
    t = S.VersionedTable(spark, str(tmp_path / "offers"))
    t.write(spark.range(1))
    spark.range(50, 60).write.parquet(f"{t.path}/v=2")  # written, never committed
    assert t.version() == 1 and [r[0] for r in t.read().collect()] == [0]
    assert t.append(spark.range(7, 8)) == 2 and sorted(r[0] for r in t.read().collect()) == [0, 7]


def test_wins_with_maps_and_ties(spark):
    df = spark.createDataFrame([("k", 1, {"a": "x"}), ("k", 1, {"a": "y"}), ("j", 2, None)], "key string, position int, v map<string,string>")
    first = {r["key"]: r["v"] for r in S.last_wins(df, F.col("key"), "position").collect()}
    assert first == {r["key"]: r["v"] for r in S.last_wins(df.orderBy(F.desc("v.a")), F.col("key"), "position").collect()} and first["j"] is None
    assert S.latest_by(df, ["key"], ["position"]).count() == 2 == S.first_wins(df, F.col("key"), "position").count()


def test_run_log_and_quality(spark, tmp_path):
    log = S.RunLog(S.VersionedTable(spark, str(tmp_path / "runs")))
    assert log.start("all", "one", "list", T1) == 1 and log.start("all", "two", "list", T2) == 2
    log.finish(1, S.RunCounters(3, 10, 9, 1), "ok", T3)
    rows = {r["id"]: r for r in log.rows().collect()}
    assert rows[1]["status_message"] == "ok" and rows[1]["started_at"] == T1 and rows[1]["offers_fetched"] == 9 and rows[2]["finished_at"] is None
    assert S.run_quality(S.RunCounters(1, 10, 9, 1), 0.1) == "ok" and S.run_quality(S.RunCounters(1, 10, 8, 2), 0.1) == "failed" and S.run_quality(S.RunCounters(1, 0, 0, 0), 0.1) == "empty"


def test_union_of_sources_survives_a_failing_one(spark):
    def broken():
        return spark.range(1).select(F.raise_error(F.lit("gone")).alias("id"))

    rows, errors = S.isolated_union({"a": lambda: spark.range(2), "b": broken, "c": lambda: spark.range(1)})
    assert sorted((r["part"], r["id"]) for r in rows.collect()) == [("a", 0), ("a", 1), ("c", 0)] and list(errors) == ["b"]
    assert S.isolated_union({"b": broken})[0] is None


def test_cache_put_keeps_valid_answers_only(spark):
    ddl = "content_hash string, classifier_version string, response_json string, created_at timestamp"
    cache = spark.createDataFrame([("h1", "v", "old", T1), ("h2", "v", "kept", T1)], ddl)
    answers = spark.createDataFrame([("h1", "v", "new"), ("h3", "v", "bad"), ("h4", "v", "b"), ("h4", "v", "a"), ("h5", "v", None)], "content_hash string, classifier_version string, response_json string")
    got = S.cache_put(cache, answers, F.col("response_json") != "bad", F.lit(T2))
    assert sorted((r["content_hash"], r["response_json"]) for r in got.collect()) == [("h1", "new"), ("h2", "kept"), ("h4", "a")]


def test_frontier_is_breadth_first_and_capped():
    graph = {"a": ["b", "c"], "b": ["d", "a"], "c": ["e"], "d": [], "e": []}
    assert S.frontier(["a"], graph.get, 50) == (["a", "b", "c", "d", "e"], False)
    assert S.frontier(["a"], graph.get, 2) == (["a", "b"], True)


def test_first_owner(spark):
    df = spark.createDataFrame([("u", "x", 1, 0, 0), ("u", "y", 0, 4, 2), ("v", "x", 1, 0, 1)], "url string, kind string, kind_order int, page int, position int")
    assert sorted((r["url"], r["kind"]) for r in S.first_owner(df).collect()) == [("u", "y"), ("v", "x")]


def test_rules(spark):
    pack = Dictionary((("learn", "ml"), ("learning", "ml"), ("data", "data")))
    df = spark.createDataFrame([("Deep Learning", "", None, "raw DATA"), ("x", "data", "", "raw")], "title string, description string, skills string, raw_text string")
    text = assembled_text("title", body=("description", "skills"), fallback="raw_text")
    got = df.select(text.alias("t"), pack.labels(text).alias("l"), capped_score([(F.size(pack.labels(text)), 30, 50)]).alias("s")).collect()
    assert [(r["t"], r["l"], r["s"]) for r in got] == [("deep learning raw data", ["ml", "ml", "data"], 0.5), ("x data", ["data"], 0.3)]
    whole = Dictionary((("learn", "ml"),), word_boundary=True)
    assert df.select(F.size(whole.labels(text)).alias("n")).first()["n"] == 0
    null = F.lit(None).cast("boolean")
    assert df.select(cascade([(null, "a"), (F.lit(True), "b"), (F.lit(True), "c")], "d").alias("x")).first()["x"] == "b"


def test_stream_merges_into_versions(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    state = S.VersionedTable(spark, str(tmp_path / "state"))
    schema = "url string, n int, first_seen_at string"

    def go():
        q = merge_stream(stream_rows(spark, str(folder), schema), state, "url", keep=["first_seen_at"], order="n", checkpoint=str(tmp_path / "cp"))
        assert q.awaitTermination(120)

    (folder / "1.json").write_text('{"url":"a","n":1,"first_seen_at":"t1"}\n{"url":"a","n":2,"first_seen_at":"t2"}\n')
    go()
    (folder / "2.json").write_text('{"url":"a","n":3,"first_seen_at":"t3"}\n{"url":"b","n":1,"first_seen_at":"t3"}\n')
    go()
    assert sorted(tuple(r) for r in state.read().select("url", "n", "first_seen_at").collect()) == [("a", 3, "t2"), ("b", 1, "t3")]
    shutil.rmtree(tmp_path / "cp" / "commits")  # a crash after the merge and before the stream notes it: the batches come again
    before = state.version()
    go()
    assert state.version() == before


def test_places_in_a_total_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("n")).repartition(7)
    got = S.positioned(df, F.desc("n")).collect()
    assert [(r["n"], r["position"]) for r in got] == [(999 - i, i + 1) for i in range(1000)]
    assert [(r["n"], r["position"]) for r in S.top(df, 3, "n").collect()] == [(0, 1), (1, 2), (2, 3)] and S.positioned(df.filter("false"), "n").count() == 0

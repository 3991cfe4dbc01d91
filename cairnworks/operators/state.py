"""Keyed state in plain tables: merge by key, append, disappearance, caches, versions, the run log.

Parquet tables know no MERGE: a merge is a full outer join written as the next version of the table. A version
exists once its commit file does, which is created after its data and never changed, so no reader sees a
half-written table and a crash leaves the version before.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnworks.runtime import cut


def merge_by_key(current: DataFrame, incoming: DataFrame, key: str, *, keep: list[str], touch: dict[str, Column] | None = None) -> DataFrame:
    """Incoming rows replace current ones of their key in all columns but those in `keep`; other rows stay.

    Columns that only one side has are filled with null. touch: further columns of merged or new rows.
    """
    names = [*current.columns, *[c for c in incoming.columns if c not in current.columns]]
    mark = incoming.withColumns(touch or {}).withColumn("__in", F.lit(True)).alias("n")
    old = current.alias("o")
    joined = old.join(mark, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    fresh = F.coalesce(F.col("n.__in"), F.lit(False))

    def pick(c: str) -> Column:
        has_old, has_new = c in current.columns, c in mark.columns
        if c == key or (c in keep and has_old):
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if has_new else F.col(f"o.{c}")
        if has_new and has_old:
            return F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        return F.col(f"n.{c}") if has_new else F.col(f"o.{c}")

    return joined.select(*[pick(c).alias(c) for c in dict.fromkeys([*names, *(touch or {})])])


def mark_missing(current: DataFrame, seen: DataFrame, key: str, *, within: Column, now: Column, complete: bool) -> DataFrame:
    """Rows `within` the inventory that were not seen become `missing`. An incomplete inventory changes nothing."""
    if not complete:
        return current
    flagged = current.join(seen.select(key).distinct().withColumn("__seen", F.lit(True)), key, "left")
    gone = F.col("__seen").isNull() & within
    return flagged.withColumns({"last_seen_at": F.when(gone, now).otherwise(F.col("last_seen_at")), "last_seen_status": F.when(gone, "missing").otherwise(F.col("last_seen_status"))}).drop("__seen").select(*current.columns)


def with_defaults(df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """Additive schema migration: columns that are absent come with their default; present ones stay."""
    return df.withColumns({c: d for c, d in added.items() if c not in df.columns})


def _content(df: DataFrame) -> Column:
    """Settles rows of equal position by what they hold; works for maps too."""
    return F.xxhash64(F.to_json(F.struct(*df.columns)))


def last_wins(df: DataFrame, key: Column, position: str, tie: Column | None = None) -> DataFrame:
    """The last row of each key at the place of its first: no window over a hot key, one aggregation. tie: settles equal positions, by default what the rows hold."""
    row, order = F.struct(*df.columns), F.struct(F.col(position), _content(df) if tie is None else tie)
    return df.groupBy(key.alias("__key")).agg(F.max_by(row, order).alias("__row"), F.min(position).alias("first_position")).select("__row.*", "first_position")


def first_wins(df: DataFrame, key: Column, position: str, tie: Column | None = None) -> DataFrame:
    row, order = F.struct(*df.columns), F.struct(F.col(position), _content(df) if tie is None else tie)
    return df.groupBy(key.alias("__key")).agg(F.min_by(row, order).alias("__row")).select("__row.*")


def latest_by(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.max_by(F.struct(*df.columns), F.struct(*order, _content(df))).alias("__row")).select("__row.*")


def changed_versions(snapshots: DataFrame, offers: DataFrame) -> DataFrame:
    """Keys with more than one distinct hash; aggregated before the join."""
    spans = (
        snapshots.groupBy("offer_url").agg(F.countDistinct("content_hash").alias("versions"), F.min("fetched_at").alias("first_snapshot"), F.max("fetched_at").alias("last_snapshot"))
        .filter("versions > 1")
    )
    return spans.join(offers.select("url", "title", "source"), spans["offer_url"] == offers["url"]).select("url", "title", "source", "versions", "first_snapshot", "last_snapshot")


def cache_lookup(rows: DataFrame, cache: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Hits (rows with their cached response) and misses (rows without), by hash and classifier version."""
    held = cache.filter(F.col("classifier_version") == version).select("content_hash", "response_json")
    return rows.join(held, "content_hash"), rows.join(held, "content_hash", "left_anti")


def cache_put(cache: DataFrame, answers: DataFrame, valid: Column, now: Column) -> DataFrame:
    """The cache with the valid answers (content_hash, classifier_version, response_json); an invalid one is never kept.

    Of several answers of a key the first in order of their text counts; a key that is held already gets the new answer.
    """
    key = ["content_hash", "classifier_version"]
    fresh = answers.filter(F.coalesce(valid, F.lit(False))).groupBy(*key).agg(F.min("response_json").alias("response_json")).withColumn("created_at", now)
    return cache.join(fresh.select(*key), key, "left_anti").unionByName(fresh.select(*cache.columns))


class VersionedTable:
    """A table of versions under one folder. The commit file of a version lists the data folders it consists of."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The greatest committed version; 0 where there is none."""
        jvm, fs = self._fs()
        commits = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_commits")
        names = [x.getPath().getName() for x in fs.listStatus(commits)] if fs.exists(commits) else []
        return max((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), default=0)

    def commit(self, version: int | None = None) -> dict:
        """What the commit file of a version says: `folders`, and `batches`, the last batch of each stream."""
        v = self.version() if version is None else version
        if not v:
            return {"folders": [], "batches": {}}
        return json.loads(self.spark.read.text(f"{self.path}/_commits/{v}.json", wholetext=True).first()[0])

    def read(self) -> DataFrame | None:
        folders = self.commit()["folders"]
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{x}" for x in folders]) if folders else None

    def _commit(self, df: DataFrame, before: list[str], batches: dict[str, int]) -> int:
        v = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={v}")  # a folder left by a crash has no commit file
        jvm, fs = self._fs()
        made = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_commits/.{v}.new")
        out = fs.create(made, True)
        out.write(bytearray(json.dumps({"folders": [*before, f"v={v}"], "batches": batches}).encode()))
        out.close()
        if not fs.rename(made, jvm.org.apache.hadoop.fs.Path(f"{self.path}/_commits/{v}.json")):
            raise RuntimeError(f"version {v} of {self.path} was committed by another writer")
        return v

    def write(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """df as the next version. batch: the stream and the number of the batch it comes from."""
        return self._commit(df, [], self.commit()["batches"] | dict([batch] if batch else []))

    def append(self, df: DataFrame) -> int:
        """The next version: the folders of the one before, and df beside them; nothing is written again."""
        held = self.commit()
        return self._commit(df, held["folders"], held["batches"])


RUN = "id long, started_at timestamp, finished_at timestamp, profile string, source string, source_kind string, pages_fetched long, offers_discovered long, offers_fetched long, errors_count long, status_message string"


def next_run_id(runs: DataFrame) -> int:
    return (runs.agg(F.max("id")).first()[0] or 0) + 1


@dataclass
class RunCounters:
    """What a run has done so far."""

    pages_fetched: int = 0
    offers_discovered: int = 0
    offers_fetched: int = 0
    errors_count: int = 0


class RunLog:
    """A run is appended once as open and once as closed; `rows` gives the last state of each."""

    def __init__(self, log: VersionedTable):
        self.log = log

    def rows(self) -> DataFrame:
        held = self.log.read()
        if held is None:
            return self.log.spark.createDataFrame([], RUN)
        return held.groupBy("id").agg(F.max_by(F.struct(*held.columns), F.struct(F.col("finished_at").isNotNull(), "finished_at")).alias("x")).select("x.*")

    def start(self, profile: str, source: str, source_kind: str, now: datetime) -> int:
        run = next_run_id(self.rows())
        self._append((run, now, None, profile, source, source_kind, 0, 0, 0, 0, None))
        return run

    def finish(self, run: int, counters: RunCounters, status: str, now: datetime) -> None:
        opened = self.rows().filter(F.col("id") == run).first()
        if opened is None:
            raise ValueError(f"run {run} was never started")
        c = counters
        self._append((run, opened["started_at"], now, opened["profile"], opened["source"], opened["source_kind"], c.pages_fetched, c.offers_discovered, c.offers_fetched, c.errors_count, status))

    def _append(self, row: tuple) -> None:
        self.log.append(self.log.spark.createDataFrame([row], RUN).coalesce(1))


def run_quality(counters: RunCounters, max_error_rate: float) -> str:
    """`empty` when nothing was discovered, `failed` when too large a share of the fetches erred, else `ok`."""
    tried = counters.offers_fetched + counters.errors_count
    if not counters.offers_discovered or not tried:
        return "empty"
    return "failed" if counters.errors_count / tried > max_error_rate else "ok"


def isolated_union(parts: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """The rows of all parts that can be made, with their name as `part`, and the errors of the others.

    Each part is run once and kept in the shared checkpoint folder, so a part that fails late takes no other along.
    """
    done, errors = [], {}
    for name, make in parts.items():
        try:
            done.append(cut(make().withColumn("part", F.lit(name))))
        except Exception as e:  # noqa: BLE001
            errors[name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    out = None
    for df in done:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, errors


def positioned(df: DataFrame, *order: Column | str, into: str = "position") -> DataFrame:
    """df in a total order with the place of each row, counted from 1: a range sort, whose partitions are counted, not a window over all rows."""
    placed = cut(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__id", 33)  # above the number within the partition
    ahead = placed.groupBy(part.alias("__part")).count().withColumn("__ahead", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = placed.withColumn("__part", part).join(ahead.select("__part", "__ahead"), "__part")
    return rows.withColumn(into, F.col("__ahead") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__id", "__part", "__ahead").orderBy(into)


def top(df: DataFrame, count: int, *order: Column | str, into: str = "position") -> DataFrame:
    """The first rows of a total order with their place; only these are numbered."""
    return df.orderBy(*order).limit(count).withColumn(into, F.row_number().over(Window.orderBy(*order)).cast("long"))


def frontier(seed: list[str], links, limit: int) -> tuple[list[str], bool]:
    """Breadth-first crawl order of list pages: (pages in order, whether the cap was reached)."""
    order, seen, queue = [], set(seed), list(seed)
    while queue and len(order) < limit:
        page = queue.pop(0)
        order.append(page)
        for nxt in links(page):
            if nxt not in seen:
                seen.add(nxt)
                queue.append(nxt)
    return order, bool(queue)


def first_owner(urls: DataFrame) -> DataFrame:
    """Of (url, kind, kind_order, page, position) the first kind that lists a url owns it."""
    row = F.struct(*urls.columns)
    return urls.groupBy("url").agg(F.min_by(row, F.struct("kind_order", "page", "position")).alias("__row")).select("__row.*")

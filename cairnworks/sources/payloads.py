"""Payload sources: files on shared storage, tables of raw pages, adapters, and a paginated data source.

A source gives DataFrames, not objects: urls, payloads, records. Live HTTP is behind the `Fetcher` protocol
and is called in partitions, after the anti-join with the pages already held, with retries and linear backoff.
"""

from __future__ import annotations

import json
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGES = "url string, payload string, error string"


class Fetcher(Protocol):
    def __call__(self, url: str) -> str: ...


class RetryableError(Exception):
    """A transport error or a status that may pass: 429, 500, 502, 503, 504."""


class AuthError(Exception):
    """The session is missing, malformed or logged out."""


def with_retries(fetch: Fetcher, *, retries: int = 2, backoff: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Fetcher:
    def call(url: str) -> str:
        for attempt in range(retries + 1):
            try:
                return fetch(url)
            except RetryableError:
                if attempt == retries:
                    raise
                sleep(backoff * (attempt + 1))
        raise AssertionError

    return call


def read_files(spark: SparkSession, folder: str, pattern: str = "*.html") -> DataFrame:
    """(path, name, payload) of all matching files below a folder."""
    df = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    path = F.col("_metadata.file_path")
    return df.select(path.alias("path"), F.regexp_extract(path, r"([^/]+)\.\w+$", 1).alias("name"), F.col("value").alias("payload"))


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def fetch_missing(urls: DataFrame, held: DataFrame, fetch: Fetcher, *, delay: float = 0.5, partitions: int = 1, most: int | None = None) -> DataFrame:
    """Payloads of urls that are not held yet, then those held: a read-through cache as an anti-join.

    One partition keeps the pace of a single polite client; errors become rows. The anti-join itself runs in as many tasks
    as the plan has. most: only so many urls, the first by `position` (or by url), before anything is fetched.
    """
    if most is not None:
        order = ["position", "url"] if "position" in urls.columns else ["url"]
        urls = urls.groupBy("url").agg(*[F.min(c).alias(c) for c in order if c != "url"]).orderBy(*order).limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                try:
                    rows.append((url, fetch(url), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((url, None, f"{type(e).__name__}: {e}"))
                time.sleep(delay)
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["url", "payload", "error"])

    wanted = urls.select("url").distinct()
    new = wanted.join(held, "url", "left_anti").repartition(partitions).mapInArrow(run, PAGES)
    return new.unionByName(wanted.join(held, "url").select("url", "payload", F.lit(None).cast("string").alias("error")))


def session_cookies(text: str) -> dict[str, str]:
    """Usable cookies of a session file: a list, or an object with `cookies`; names are non-empty, values not null."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise AuthError("the session file is not JSON") from e
    rows = data.get("cookies") if isinstance(data, dict) else data
    if not isinstance(rows, list):
        raise AuthError("the session file holds no list of cookies")
    out = {r["name"]: r["value"] for r in rows if isinstance(r, dict) and isinstance(r.get("name"), str) and r["name"] and r.get("value") is not None}
    if not out:
        raise AuthError("the session file holds no usable cookie")
    return out


@dataclass(frozen=True)
class SourceDefinition:
    name: str
    display_name: str
    requires_auth: bool


class SourceAdapter(ABC):
    """What a source must give: urls, payloads of urls, records of payloads."""

    definition: SourceDefinition

    @abstractmethod
    def urls(self, spark: SparkSession) -> DataFrame: ...

    @abstractmethod
    def payloads(self, urls: DataFrame) -> DataFrame: ...

    @abstractmethod
    def records(self, payloads: DataFrame) -> DataFrame: ...

    def run(self, spark: SparkSession) -> DataFrame:
        return self.records(self.payloads(self.urls(spark))).withColumn("source", F.lit(self.definition.name))


class Registry:
    def __init__(self, *definitions: SourceDefinition):
        self._by_name = {d.name: d for d in definitions}

    def __getitem__(self, name: str) -> SourceDefinition:
        if name not in self._by_name:
            raise ValueError(f"unknown source: {name}")
        return self._by_name[name]

    def dimension(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(d.name, d.display_name, d.requires_auth) for d in self._by_name.values()], "name string, display_name string, requires_auth boolean")


class FolderAdapter(SourceAdapter):
    """Detail pages saved as files; the record function turns (url, html) into rows."""

    def __init__(self, definition: SourceDefinition, folder: str, records: Callable[[DataFrame], DataFrame]):
        self.definition, self.folder, self._records = definition, folder, records

    def urls(self, spark: SparkSession) -> DataFrame:
        return read_files(spark, self.folder).select(F.col("path").alias("url"))

    def payloads(self, urls: DataFrame) -> DataFrame:
        return urls.join(read_files(urls.sparkSession, self.folder).select(F.col("path").alias("url"), F.col("payload").alias("html")), "url")

    def records(self, payloads: DataFrame) -> DataFrame:
        return self._records(payloads)


def paged_files(spark: SparkSession, folder: str, total: int, length: int = 25) -> DataFrame:
    """(start, payload, error) of pages saved as <start>.json on any file system; an absent page is a row with an error."""
    offsets = spark.range(0, total, length).select(F.col("id").cast("int").alias("start"))
    pages = read_files(spark, folder, "*.json").select(F.expr("try_cast(name AS INT)").alias("start"), "payload")
    return offsets.join(pages, "start", "left").withColumn("error", F.when(F.col("payload").isNull(), "page missing"))


# --- a paginated source, one partition per offset ---------------------------------------------------------


class _Offset(InputPartition):
    def __init__(self, start: int):
        super().__init__(start)
        self.start = start


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.total, self.length = options["path"], int(options["total"]), int(options.get("length", "25"))
        self.missing = options.get("missing", "fail")

    def partitions(self):
        return [_Offset(s) for s in range(0, self.total, self.length)]

    def read(self, partition):
        import os

        name = os.path.join(self.folder, f"{partition.start}.json")
        if not os.path.exists(name) and self.missing == "skip":
            return
        with open(name, encoding="utf-8") as f:
            yield partition.start, f.read()


class PaginatedJson(DataSource):
    """`format("paginated_json")`: pages saved as <start>.json in a mounted shared folder, read one offset per partition.

    A page that is absent fails the read; option missing=skip leaves it out. `paged_files` reads any file system instead.
    """

    @classmethod
    def name(cls):
        return "paginated_json"

    def schema(self):
        return "start int, payload string"

    def reader(self, schema):
        return _PageReader(self.options)

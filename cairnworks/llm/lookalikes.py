"""Pairs of records whose text looks the same but is another string.

Every text is brought to its canonical form by the transducer of `textforms`; only digests of the form and
of the string travel. Classes with a single string, however many rows hold it, are left before any pair is
made; within the others only rows of different strings are joined.

Defined cases: null and empty texts, and texts of invisible characters only, never count; texts that differ
in runs of ordinary spaces, tabs and line breaks only are one string; repeated rows of a key give one pair;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.llm.textforms import canonical, respaced
from cairnworks.runtime import cut, spread


def _form_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms = [canonical(t) for t in batch.column(2).to_pylist()]
        keep = pa.array([bool(f) for f in forms], pa.bool_())
        batch = batch.filter(keep)
        classes = pa.array([xxhash.xxh128_digest(f) for f in forms if f], pa.binary())
        variants = pa.array([xxhash.xxh128_digest(respaced(t)) for t in batch.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), classes, variants], names=["key", "field_name", "class", "variant"])


def _forms(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, class, variant): digests of the canonical form and of the string."""
    long = rows.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("x"))
    texts = long.select("key", "x.field_name", "x.text").filter("key IS NOT NULL AND text IS NOT NULL AND text <> ''")
    return cut(spread(texts).mapInArrow(_form_batches, "key string, field_name string, class binary, variant binary").distinct())  # read twice by both forms below


OF_CLASS = ["field_name", "class"]


def _mixed(forms: DataFrame) -> DataFrame:
    """Classes of more than one string; their number of strings and of rows."""
    return forms.groupBy(*OF_CLASS).agg(F.countDistinct("variant").alias("variants"), F.countDistinct("key").alias("records"), F.min("key").alias("class_id")).filter("variants > 1")


def same_looking_pairs(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key_a, key_b, field_name), key_a < key_b."""
    forms = _forms(rows, key, fields)
    inside = forms.join(forms.groupBy(*OF_CLASS).agg(F.min("variant").alias("lo"), F.max("variant").alias("hi")).filter("lo <> hi").select(*OF_CLASS), OF_CLASS, "left_semi")
    a = inside.select(*OF_CLASS, F.col("key").alias("key_a"), F.col("variant").alias("va"))
    b = inside.select(*OF_CLASS, F.col("key").alias("key_b"), F.col("variant").alias("vb"))
    return a.join(b, OF_CLASS).filter("key_a < key_b AND va <> vb").select("key_a", "key_b", "field_name").distinct()


def same_looking_classes(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, class_id, variant_id, variants, records): one row per record and field that looks like another string.

    Two records of a class that differ in variant_id are a pair of same_looking_pairs; no pair is made. class_id and
    variant_id are the least key of each; a hot class is counted on the map side.
    """
    forms = _forms(rows, key, fields)
    names = forms.groupBy(*OF_CLASS, "variant").agg(F.min("key").alias("variant_id"))
    return forms.join(_mixed(forms), OF_CLASS).join(names, [*OF_CLASS, "variant"]).select("key", "field_name", "class_id", "variant_id", "variants", "records")

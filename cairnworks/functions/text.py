"""Text functions as column expressions; Python only for Unicode decomposition."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Contact patterns and the placeholders that stand for masked contacts.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:(?:\+|00)33[\s.-]?(?:\(0\)[\s.-]?)?|0)[1-9](?:[\s.-]?\d{2}){4}"
CONTACT = f"{EMAIL}|{PHONE}"
EMAIL_PLACEHOLDER = "contact@example.invalid"
PHONE_PLACEHOLDER = "00 00 00 00 00"  # no phone itself: it has no digit from 1 to 9 after the first


def blank_to_null(c: Column) -> Column:
    """The empty string counts as missing."""
    return F.nullif(c, F.lit(""))


def clean(c: Column) -> Column:
    """Runs of white space, no-break and control separators included, as one space; no space at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def text_or_null(c: Column) -> Column:
    return blank_to_null(clean(c))


def safe_int(c: Column) -> Column:
    """A whole number, white space around it allowed; null for anything else."""
    return F.trim(c).try_cast("int")


def yes_no(c: Column) -> Column:
    return F.when(c, "oui").when(~c, "non")


def has_contact(c: Column) -> Column:
    return F.coalesce(c.rlike(CONTACT), F.lit(False))


def leaks_contact(c: Column) -> Column:
    """An email other than the placeholder, or any phone."""
    others = F.array_except(F.regexp_extract_all(c, F.lit(f"({EMAIL})"), F.lit(1)), F.array(F.lit(EMAIL_PLACEHOLDER)))
    return F.coalesce((F.size(others) > 0) | c.rlike(PHONE), F.lit(False))


def anonymised(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, EMAIL, EMAIL_PLACEHOLDER), PHONE, PHONE_PLACEHOLDER)


def anonymised_map(c: Column) -> Column:
    """A map of strings with contacts masked in every value."""
    return F.transform_values(c, lambda _, v: anonymised(v))


def anonymised_list(c: Column) -> Column:
    return F.transform(c, anonymised)


def absolute_url(c: Column, base: str) -> Column:
    """http(s) links stay; a path is put after the host, anything else after the host and a slash."""
    return F.when(c.rlike("^https?://"), c).when(c.startswith("/"), F.concat(F.lit(base), c)).otherwise(F.concat(F.lit(base + "/"), c))


def with_scheme(c: Column, host: str) -> Column:
    """A sitemap location with its scheme and host."""
    return (
        F.when(c.rlike("^https?://"), c).when(c.startswith("//"), F.concat(F.lit("https:"), c))
        .when(c.startswith("/"), F.concat(F.lit(f"https://{host}"), c)).otherwise(F.concat(F.lit("https://"), c))
    )


def reference_of_url(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)


def reference_in_url(url: str) -> str | None:
    return url.rstrip("/").split("/")[-1] or None


def with_language(c: Column, language: str = "FR") -> Column:
    """A detail url with the language asked for, unless it has a query of its own."""
    return F.when(F.contains(c, F.lit("?")), c).otherwise(F.concat(c, F.lit(f"?lang={language}")))


def slug(text: str | None) -> str | None:
    if text is None:
        return None
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return re.sub(r"[^A-Za-z0-9]+", "-", plain).strip("-").lower() or "snapshot"


def with_slug(df: DataFrame, column: str, into: str = "slug") -> DataFrame:
    """df with the slug of a string column, in Arrow batches."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([slug(x) for x in b.column(at).to_pylist()], pa.string())], names=[*b.schema.names, into])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {into} string")

"""Sinks: CSV, Markdown, JSON seeds, anonymised trees, gate and run reports. Only limited or per-row results reach one writer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnworks.functions.text import anonymised, anonymised_list, anonymised_map, blank_to_null, leaks_contact, yes_no

# The columns of the CSV export in order, and the keys of source_specific among them.
CSV_COLUMNS = (
    "reference", "source", "origin", "bucket", "score", "title", "contract", "level", "contract_type", "duration", "education_level", "location", "lab", "published_at_text", "company", "source_laboratory", "sector", "discipline",
    "doctoral_school", "partner_expected", "remote_or_hybrid", "funding_status", "cifre_status", "contact_visible", "application_deadline", "category", "summary", "why_interesting", "reason", "flags", "url",
)
SPECIFIC = {"company": "company_name", "source_laboratory": "laboratory_name", **{k: k for k in ("sector", "discipline", "doctoral_school", "partner_expected", "remote_or_hybrid", "funding_status", "cifre_status", "contact_visible", "application_deadline")}}
_STORED = {
    "bucket": "target_bucket", "score": "ai_relevance_score", "contract": "contract_type", "level": "education_level", "category": "ai_category", "summary": "short_summary", "reason": "ai_reason",
    **{k: k for k in ("reference", "source", "title", "contract_type", "duration", "education_level", "location", "lab", "published_at_text", "why_interesting", "url")},
}


def specific(key: str) -> Column:
    return F.get_json_object("source_specific", f"$.{key}")


def display_origin(names: dict[str, str], kinds: dict[str, str]) -> Column:
    """The name of a row's source, or of its kind where the source has kinds; an unknown source stands for itself."""
    out = F.col("source")
    for source, name in names.items():
        out = F.when(F.col("source") == source, F.lit(name)).otherwise(out)
    for kind, name in kinds.items():
        out = F.when((F.col("source") == "anrt") & (specific("anrt_kind") == kind), F.lit(name)).otherwise(out)
    return out


def csv_columns(df: DataFrame, origin: Column) -> DataFrame:
    """The columns of the export as strings, null as empty; flags joined by commas."""
    held = {**{k: F.col(c).cast("string") for k, c in _STORED.items()}, **{k: specific(c) for k, c in SPECIFIC.items()}, "origin": origin, "flags": F.array_join("risk_flags", ",")}
    return df.select(*[F.coalesce(held[c], F.lit("")).alias(c) for c in CSV_COLUMNS])


def write_csv(df: DataFrame, folder: str, columns: list[str]) -> None:
    """Header, fixed columns, nulls as empty; one file per partition of the input."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(folder)


# Labels of the detail lines and of the lines of a digest, in order.
DETAIL_LABELS = {
    "company_name": "Entreprise", "laboratory_name": "Laboratoire source", "sector": "Secteur", "discipline": "Discipline", "doctoral_school": "École doctorale", "partner_expected": "Partenaire attendu",
    "remote_or_hybrid": "Télétravail / hybride", "funding_status": "Statut financement", "cifre_status": "Statut CIFRE", "contact_visible": "Contact visible", "application_deadline": "Date limite",
}
BLOCK_LABELS = {
    "Type": "contract_type", "Durée": "duration", "Niveau": "education_level", "Lieu": "location", "Labo": "lab", "Publication": "published_at_text",
}
BLOCK_TEXTS = {"Résumé": "short_summary", "Intérêt": "why_interesting", "Pourquoi": "ai_reason"}


def detail_lines(source: str = "anrt") -> Column:
    """The lines of source_specific that have a value, for rows of one source; true and false as words."""
    line = lambda k, label: F.concat(F.lit(f"- {label} : "), yes_no(specific(k).try_cast("boolean")) if k == "contact_visible" else blank_to_null(specific(k)))
    lines = F.filter(F.array(*[line(k, label) for k, label in DETAIL_LABELS.items()]), lambda x: x.isNotNull())
    return F.when(F.col("source") == source, lines).otherwise(F.expr("cast(array() AS array<string>)"))


def offer_block(origin: Column) -> Column:
    """One row of a digest as Markdown."""
    named = lambda label, c: F.concat(F.lit(f"- {label} : "), F.coalesce(blank_to_null(F.col(c)), F.lit("n/a")))
    score = F.coalesce(F.when(F.col("ai_relevance_score").isNotNull(), F.format_string("%.2f", "ai_relevance_score")), F.lit("n/a"))
    flags = F.coalesce(blank_to_null(F.array_join("risk_flags", ", ")), F.lit("aucun"))
    before = F.array(F.concat(F.lit("### "), "title"), F.lit(""), F.concat(F.lit("- Source : "), origin), *[named(k, c) for k, c in BLOCK_LABELS.items()])
    after = F.array(F.concat(F.lit("- Score : "), score), *[named(k, c) for k, c in BLOCK_TEXTS.items()], F.concat(F.lit("- Flags : "), flags), F.concat(F.lit("- Lien : "), "url"))
    return F.array_join(F.concat(before, detail_lines(), after), "\n")


def markdown(title: str, blocks: DataFrame, section: str, order: list[str], names: dict[str, str], limit: int) -> str:
    """A digest: sections in the given order, `block` strings in the order of `position`; at most `limit` blocks."""
    rows = blocks.select(section, "position", "block").orderBy("position").limit(limit).collect()
    out = [f"# {title}", ""]
    if not rows:
        out.append("Nothing to show.")
    for key in order:
        own = [r["block"] for r in rows if r[section] == key]
        if own:
            out += [f"## {names.get(key, key)}", "", *[b + "\n" for b in own]]
    return "\n".join(out).rstrip() + "\n"


def gate_table(gates: DataFrame) -> str:
    """All gates as a Markdown table, of which there are as many as a report defines; bars in cells are escaped."""
    cell = lambda v: str(v).replace("|", "\\|")
    rows = gates.select("gate", "passed", "detail").toLocalIterator()
    return "\n".join(["| gate | passed | detail |", "| --- | --- | --- |", *[f"| {cell(r[0])} | {'yes' if r[1] else 'no'} | {cell(r[2])} |" for r in rows]]) + "\n"


def run_report(title: str, facts: dict[str, object], audit: DataFrame | None = None) -> str:
    """Facts of a run as a list, and the audit of its kinds as a table."""
    lines = [f"# {title}", "", *[f"- {k} : {'n/a' if v is None else v}" for k, v in facts.items()]]
    if audit is not None:
        lines += ["", "| " + " | ".join(audit.columns) + " |", "| " + " | ".join("---" for _ in audit.columns) + " |"]
        lines += ["| " + " | ".join("n/a" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in audit.orderBy(audit.columns[0]).toLocalIterator()]
    return "\n".join(lines) + "\n"


SEED_FIELDS = ("reference", "title", "contract_type", "duration", "education_level", "experience_level", "location", "lab", "published_at_text", "description", "skills")


def seed_case() -> Column:
    """A labelled case of a row as a struct, with contacts masked in every text, also within source_specific."""
    held = F.from_json("source_specific", "map<string,string>")
    kept = F.map_filter(held, lambda _, v: v.isNotNull() & (v != ""))
    offer = F.struct("source", anonymised_map(kept).alias("source_specific"), "url", *[anonymised(F.col(c)).alias(c) for c in SEED_FIELDS], F.coalesce(anonymised(F.col("raw_text")), F.lit("")).alias("raw_text"), anonymised_list(F.col("risk_flags")).alias("risk_flags"))
    return F.struct(
        F.coalesce(blank_to_null(F.col("reference")), "url").alias("reference"), F.col("target_bucket").alias("expected_bucket"), F.coalesce("ai_category", F.lit("not_relevant")).alias("expected_ai_domain"), F.col("accessibility").alias("expected_accessibility"),
        F.lit("To be read and confirmed: the label is the classifier's.").alias("notes"), offer.alias("offer"),
    )


def write_anonymised(pages: DataFrame, folder: str) -> DataFrame:
    """Writes (path, payload) with contacts masked as a table, and gives the count of pages written."""
    pages.select("path", anonymised(F.col("payload")).alias("payload")).write.mode("overwrite").parquet(folder)
    return pages.sparkSession.read.parquet(folder).agg(F.count("*").alias("written"))


def write_anonymised_tree(pages: DataFrame, root: str, folder: str) -> int:
    """The files of (path, payload) below `root` again below a mounted shared folder, contacts masked; the number written."""
    masked = pages.select(F.regexp_replace("path", "^.*?" + root.strip("/") + "/", "").alias("path"), anonymised(F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, payload in zip(*(c.to_pylist() for c in batch.columns)):
                at = os.path.join(folder, path)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at + ".part", "w", encoding="utf-8") as f:
                    f.write(payload or "")
                os.replace(at + ".part", at)  # a task that runs again writes the same file
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["written"])

    return masked.mapInArrow(run, "written long").agg(F.sum("written")).first()[0] or 0


def write_json_lines(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def console(df: DataFrame, rows: int, as_json: bool = False) -> str:
    """The first rows as a text table or as JSON lines."""
    top = df.limit(rows)
    return "\n".join(top.select(F.to_json(F.struct(*top.columns), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]) if as_json else top._show_string(rows, False)


# --- audit of a tree of saved pages ------------------------------------------------------------------------


def page_audit(pages: DataFrame, listed: DataFrame, wanted_lists: list[str]) -> DataFrame:
    """One row on saved pages (name, part, payload; part is `list` or `detail`) and the record names their lists link to (name):
    lists, details, absent lists, listed, absent details, leaking pages, ok."""
    counts = pages.agg(
        F.count_if(F.col("part") == "list").alias("lists"), F.count_if(F.col("part") == "detail").alias("details"),
        F.array_sort(F.array_except(F.array(*map(F.lit, wanted_lists)), F.collect_set(F.when((F.col("part") == "list") & F.col("name").isin(*wanted_lists), F.col("name"))))).alias("absent_lists"),
        F.count_if(leaks_contact(F.col("payload"))).alias("leaking"),
    )
    names = listed.select("name").distinct()
    absent = names.join(pages.filter("part = 'detail'").select("name").distinct(), "name", "left_anti")
    both = names.agg(F.count("*").alias("listed")).crossJoin(absent.agg(F.count("*").alias("absent_details")))  # single rows
    return counts.crossJoin(both).withColumn("ok", (F.size("absent_lists") == 0) & (F.col("absent_details") == 0) & (F.col("leaking") == 0))

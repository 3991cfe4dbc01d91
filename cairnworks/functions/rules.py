"""Rule packs compiled to native expressions: dictionaries, scores and ordered cascades are data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnworks.functions.text import blank_to_null


@dataclass(frozen=True)
class Dictionary:
    """Terms with labels, in declared order; matching is by substring of the lowered text, or by whole words."""

    entries: tuple[tuple[str, str], ...]
    word_boundary: bool = False

    def labels(self, text: Column) -> Column:
        """The label of every matching term, one per term."""
        terms = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(label).alias("label")) for t, label in self.entries])
        if self.word_boundary:
            padded = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
            return F.transform(F.filter(terms, lambda t: F.contains(padded, F.concat(F.lit(" "), t["term"], F.lit(" ")))), lambda t: t["label"])
        return F.transform(F.filter(terms, lambda t: F.contains(text, t["term"])), lambda t: t["label"])


def assembled_text(*fields: str, body: tuple[str, ...] = (), fallback: str | None = None) -> Column:
    """Lowered non-empty fields and body joined by spaces; the fallback stands in when the whole body is empty."""
    inner = F.concat_ws(" ", *[blank_to_null(F.col(c)) for c in body])
    if fallback:
        inner = F.when(inner == "", F.coalesce(F.col(fallback), F.lit(""))).otherwise(inner)
    return F.lower(F.concat_ws(" ", *[blank_to_null(F.col(c)) for c in fields], blank_to_null(inner)))


def capped_score(parts: list[tuple[Column, int, int]], low: int = 0, high: int = 100) -> Column:
    """Sum of count * weight, each part capped, in whole hundredths; clamped, and divided once."""
    total = F.lit(0)
    for count, weight, cap in parts:
        x = count * weight
        total = total + (F.least(x, F.lit(cap)) if cap >= 0 else F.greatest(x, F.lit(cap)))
    return F.greatest(F.least(total, F.lit(high)), F.lit(low)) / 100.0


def cascade(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The result of the first rule that holds; a null condition does not hold."""
    first, *rest = rules
    out = F.when(first[0], first[1])
    for condition, value in rest:
        out = out.when(condition, value)
    return out.otherwise(otherwise)

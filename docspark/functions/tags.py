"""Column functions over tag arrays and classification maps."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import col, strip


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def doc_type_of(tags) -> Column:
    tags = col(tags)
    return (
        F.when(F.arrays_overlap(tags, _lits(K.SYLLABUS_TAGS)), "syllabus")
        .when(F.arrays_overlap(tags, _lits(K.NOTES_TAGS)), "notes")
        .when(F.arrays_overlap(tags, _lits(K.ASSIGN_TAGS)), "assign")
        .otherwise("other")
    )


def doc_type(tags, classifications) -> Column:
    """A non-empty doc_type classification wins over the tags."""
    given = F.try_element_at(col(classifications), F.lit("doc_type"))
    return doc_type_of(F.when(F.size(given) > 0, given).otherwise(col(tags)))


def categorise_tags(tags) -> Column:
    """struct(subject, doc_type, level, term): every tag lands in exactly one list."""
    known = K.SYLLABUS_TAGS + K.NOTES_TAGS + K.ASSIGN_TAGS
    level = "|".join(K.LEVEL_WORDS)

    def is_type(t):
        return t.isin(known)

    def is_term(t):
        return ~is_type(t) & t.rlike(K.TERM_PATTERN)

    def is_level(t):
        return ~is_type(t) & ~t.rlike(K.TERM_PATTERN) & t.rlike(level)

    tags = F.coalesce(col(tags), F.array().cast("array<string>"))
    return F.struct(
        F.filter(tags, lambda t: ~is_type(t) & ~is_term(t) & ~is_level(t)).alias("subject"),
        F.filter(tags, is_type).alias("doc_type"),
        F.filter(tags, is_level).alias("level"),
        F.filter(tags, is_term).alias("term"),
    )


def clean_tags(raw, fallback, generic=K.GENERIC_TAGS) -> Column:
    """Drop blank and generic tags; top up short lists from the fallback tags."""
    kept = F.filter(
        F.transform(F.coalesce(col(raw), F.array().cast("array<string>")), strip),
        lambda t: (t != "") & ~F.lower(t).isin(list(generic)),
    )
    extra = F.filter(col(fallback), lambda t: ~F.array_contains(kept, t))
    topped = F.concat(kept, F.slice(F.array_distinct(extra), 1, 3))
    return (
        F.when(F.size(kept) < 2, col(fallback))
        .when(F.size(kept) < 3, F.slice(topped, 1, 5))
        .otherwise(F.slice(kept, 1, 6))
    )


def decode_json(c, ddl: str, empty: Column) -> Column:
    """Legacy JSON column to its nested type; null and empty text give the empty value."""
    return F.coalesce(F.from_json(F.nullif(col(c), F.lit("")), ddl), empty)

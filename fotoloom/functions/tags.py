"""Tag lists, and the text in which tags and vectors are stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fotoloom.config import EXCLUDED_TAGS, SYNONYMS


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside lambdas an expression would be computed at every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def catalog_tags(tags: str | Column) -> Column:
    """As the catalog keeps them: trimmed, without null and blank ones, in order; a null list is empty."""
    empty = F.array().cast("array<string>")
    return F.coalesce(F.filter(F.transform(_col(tags), lambda t: F.btrim(t)), lambda t: t.isNotNull() & (t != "")), empty)


def primary_tag(tags: str | Column) -> Column:
    return F.coalesce(F.get(_col(tags), F.lit(0)), F.lit("Other"))


def tags_display(tags: str | Column) -> Column:
    return F.when(F.size(_col(tags)) > 0, F.array_join(_col(tags), ", ")).otherwise("Untagged")


def has_tag(tags: str | Column, names) -> Column:
    """Some tag equals one of the names, letter case ignored."""
    return F.arrays_overlap(F.transform(_col(tags), lambda t: F.lower(t)), _strings(n.lower() for n in names))


def mentions(tags: str | Column, *parts: str) -> Column:
    """Some tag contains one of the parts, letter case ignored."""

    def any_part(t: Column) -> Column:
        found = F.lit(False)
        for p in parts:
            found = found | F.lower(t).contains(p.lower())
        return found

    return F.exists(_col(tags), any_part)


def excluded(tags: str | Column) -> Column:
    return has_tag(tags, EXCLUDED_TAGS)


def without_synonyms(tags: str | Column) -> Column:
    """Drops the second tag of a synonym pair where the first stands too, letter case ignored; short lists are kept."""
    pairs = F.array(*(F.struct(F.lit(a.lower()).alias("keep"), F.lit(b.lower()).alias("drop")) for a, b in SYNONYMS))

    def thinned(t: Column) -> Column:
        low = _let(F.transform(t, lambda x: F.lower(x)), lambda low: F.transform(F.filter(pairs, lambda p: F.array_contains(low, p["keep"])), lambda p: p["drop"]))
        return _let(low, lambda dropped: F.filter(t, lambda x: ~F.array_contains(dropped, F.lower(x))))

    return _let(_col(tags), lambda t: F.when(F.size(t) <= 1, t).otherwise(thinned(t)))


def with_person(tags: str | Column, faces: str | Column) -> Column:
    """"Person" goes first where there are faces and no such tag in any letter case."""
    tags = _col(tags)
    return F.when((_col(faces) > 0) & ~has_tag(tags, ("Person",)), F.concat(F.array(F.lit("Person")), tags)).otherwise(tags)


def tags_to_text(tags: str | Column) -> Column:
    return F.coalesce(F.array_join(_col(tags), ", "), F.lit(""))


def tags_from_text(text: str | Column) -> Column:
    parts = F.transform(F.split(F.coalesce(_col(text), F.lit("")), ","), lambda t: F.btrim(t))
    return F.filter(parts, lambda t: t != "")


def vector_to_text(v: str | Column) -> Column:
    return F.coalesce(F.array_join(F.transform(_col(v), lambda x: x.cast("string")), ","), F.lit(""))


def vector_from_text(text: str | Column) -> Column:
    """Null for a blank text and if any element is no number; empty elements are skipped."""
    text = _col(text)
    parts = F.filter(F.split(text, ","), lambda p: F.btrim(p) != "")
    numbers = F.transform(parts, lambda p: F.btrim(p).try_cast("float"))
    return F.when((F.size(numbers) > 0) & ~F.exists(numbers, lambda x: x.isNull()), numbers)

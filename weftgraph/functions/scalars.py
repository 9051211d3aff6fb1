"""Column expressions of the citation engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_segment(x: Column) -> Column:
    return F.substring_index(F.regexp_replace(x, "/+$", ""), "/", -1)


def node_id(arxiv: Column, doi: Column, source_id: Column) -> Column:
    """The first of the three identifiers that is there, with its scheme; empty counts as missing."""
    # The schemes' names.
    some = lambda scheme, x: F.concat(F.lit(f"{scheme}:"), F.nullif(x, F.lit("")))
    return F.coalesce(some("arxiv", last_segment(arxiv)), some("doi", doi), some("openalex", last_segment(source_id)))


def abstract_text(index: Column) -> Column:
    """Text from a map of words to positions; null if there is none."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit(""))


def velocity(count: Column, year: Column, current: int) -> Column:
    """Citations a month since the year, a month at least; 0 without a year."""
    return F.when(year.isNull(), F.lit(0.0)).otherwise(count / F.greatest(F.lit(1), (F.lit(current) - year) * 12))


def backward_score(count: Column, hop: Column, year: Column, current: int, decay: float) -> Column:
    age = F.greatest(F.lit(0), F.lit(current) - F.coalesce(year, F.lit(current)))
    return F.when(count == 0, F.lit(0.0)).otherwise(count * F.log(hop + F.lit(1.0)) / F.exp(age * F.lit(float(decay))))


def acceleration(counts: Column) -> Column:
    """Mean yearly change of monthly citations over (year, count) structs; null under three years."""
    c = F.transform(F.array_sort(counts), lambda x: x["count"] / F.lit(12.0))
    steps = F.zip_with(F.slice(c, F.lit(2), F.size(c) - 1), F.slice(c, F.lit(1), F.size(c) - 1), lambda b, a: b - a)
    return F.when(F.size(c) >= 3, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.size(steps))


def forward_score(count: Column, year: Column, accel: Column, current: int, alpha: float, beta: float, decay: float) -> Column:
    """Velocity and acceleration, the latter scaled up with age; no clamp for future years."""
    age = F.when(F.coalesce(year, F.lit(0)) == 0, F.lit(0)).otherwise(F.lit(current) - year)
    return F.lit(float(alpha)) * velocity(count, year, current) + F.lit(float(beta)) * F.coalesce(accel, F.lit(0.0)) * F.exp(age * F.lit(float(decay)))


def blank(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "") == ""


def text_route(title: Column, abstract: Column) -> Column:
    return F.when(blank(title) & blank(abstract), F.lit("no_text")).otherwise(F.lit("classify"))


def keyword_share(text: Column, keywords: list[str]) -> Column:
    """Share of the keywords that the text contains, ignoring case; 0 without keywords."""
    if not keywords:
        return F.lit(0.0)
    hits = [F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(k.lower())).cast("int") for k in keywords]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total / F.lit(float(len(keywords)))


def without_fence(x: Column) -> Column:
    """The inside of a text that is exactly one code fence; any other text as it is."""
    inner = F.regexp_extract(x, r"(?s)^\s*```[A-Za-z0-9_-]*[ \t]*\n((?:(?!\n?```).)*)\n?```\s*$", 1)
    fenced = x.rlike(r"(?s)^\s*```[A-Za-z0-9_-]*[ \t]*\n(?:(?!```).)*```\s*$")
    return F.when(fenced, F.trim(inner)).otherwise(x)


def is_hex_colour(x: Column) -> Column:
    return x.rlike("^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$")


def draw_outcome(x: Column, vocabulary: list[str]) -> Column:
    """The label of a model's JSON answer, or unclear: objects only, a known label, confidence in 0 to 1."""
    v = F.try_parse_json(without_fence(x))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    label = F.try_variant_get(v, "$.relationship_type", "string")
    sure = F.try_variant_get(v, "$.confidence", "double")
    return F.when(is_object & label.isin(vocabulary) & sure.between(0, 1), label).otherwise(F.lit("unclear"))

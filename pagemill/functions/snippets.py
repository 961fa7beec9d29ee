"""Snippets with the match in bold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .variants import variants

PERSON = "\U0001f464"
STANDARD = ("name", "relative_name", "relation_name", "relation_type", "house_no", "voter_id", "epic_no", "age", "gender")


def _bold(text: Column, at: Column, size: Column) -> Column:
    return F.concat(F.substr(text, F.lit(1), at - 1), F.lit("<b>"), F.substr(text, at, size), F.lit("</b>"), F.substr(text, at + size))


def highlight(text: Column, term: Column, terms: list[str]) -> Column:
    """The first occurrence of term, else of a variant of it, in bold; terms are all values that term can have."""
    own = T.normalize(text)
    table = F.create_map(*[x for t in dict.fromkeys(terms) for x in (F.lit(t), F.array(*[F.lit(v) for v in dict.fromkeys([t, *variants(t)])]))])
    tried = F.transform(F.element_at(table, term), lambda v: F.struct(F.instr(F.lower(own), F.lower(v)).alias("at"), F.length(v).alias("size")))
    hit = F.get(F.filter(tried, lambda x: x["at"] > 0), F.lit(0))
    return F.when(hit.isNull(), text).otherwise(_bold(own, hit["at"], hit["size"]))


def window(text: Column, term: Column, around: int = 40) -> Column:
    """The term in bold with some text around it; without it, how the text begins."""
    at, size, n = F.instr(F.lower(text), F.lower(term)), F.length(term), F.length(text)
    first, last = F.greatest(at - around, F.lit(1)), F.least(at + size + around - 1, n)
    body = F.concat(F.substr(text, first, at - first), F.lit("<b>"), F.substr(text, at, size), F.lit("</b>"), F.substr(text, at + size, last - at - size + 1))
    cut = lambda c: F.when(c, "...").otherwise("")
    whole = F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))
    start = F.concat(F.substr(whole, F.lit(1), F.lit(100)), cut(F.length(whole) > 100))
    return F.when(F.coalesce(n, F.lit(0)) == 0, "").when(at == 0, start).otherwise(F.concat(cut(first > 1), F.replace(body, F.lit("\n"), F.lit(" ")), cut(last < n)))


def record(data: Column, source: Column, term: Column, terms: list[str]) -> Column:
    """The filled standard fields with their labels, then other fields that hold the term; else a window of the source."""
    get = lambda *keys: F.trim(F.coalesce(*[F.nullif(data[k], F.lit("")) for k in keys], F.lit("")))
    relation = F.coalesce(F.nullif(F.trim(data["relation_type"]), F.lit("")), F.lit("पिता"))
    shown = [
        (F.lit(f"{PERSON} "), get("name")), (F.concat(relation, F.lit(": ")), get("relation_name", "relative_name")), (F.lit("मकान: "), get("house_no")),
        (F.lit("उम्र: "), get("age")), (F.lit("लिंग: "), get("gender")), (F.lit("EPIC: "), get("voter_id", "epic_no")),
    ]
    parts = F.array(*[F.when(v != "", F.concat(label, highlight(v, term, terms))) for label, v in shown])
    table = F.create_map(*[x for t in dict.fromkeys(terms) for x in (F.lit(t), F.array(*[F.lit(v.lower()) for v in variants(t) or [t]]))])
    holds = lambda v: F.exists(F.element_at(table, term), lambda t: F.contains(F.lower(T.normalize(v)), t))
    other = F.filter(F.map_entries(data), lambda e: ~e["key"].isin(*STANDARD) & (F.coalesce(e["value"], F.lit("")) != "") & holds(e["value"]))
    extra = F.transform(other, lambda e: F.concat(T.label_of(e["key"]), F.lit(": "), highlight(F.trim(e["value"]), term, terms)))
    joined = F.array_join(F.concat(F.array_compact(parts), F.coalesce(extra, F.array().cast("array<string>"))), "  •  ")
    bare = T.strip_labels(F.coalesce(source, F.lit("")))
    return F.when(joined != "", joined).otherwise(window(F.when(bare != "", bare).otherwise(source), term))

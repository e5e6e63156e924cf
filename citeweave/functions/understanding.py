"""Query understanding: families, issues, German expansion, routing and quotas as column expressions over fixed lexicons."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.functions import lexicons as L
from citeweave.functions.text import col, first_by_lower, joined


def word(cue: str) -> str:
    """A cue as a whole word."""
    return rf"\b{re.escape(cue.lower()).replace(chr(92) + ' ', ' ').replace(chr(92) + '-', '-')}\b"


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _hits(text: Column, cues) -> Column:
    return reduce(add, [F.rlike(text, F.lit(word(c))).cast("int") for c in cues])


def likely_families(query: Column | str, most: int = 2, least: int = 4) -> Column:
    """Families by the summed weight of the cues that stand in the query; ties in lexicon order."""
    text = F.lower(F.coalesce(col(query), F.lit("")))
    scored = []
    for order, (family, cues) in enumerate(L.FAMILY_CUES.items()):
        weights = [F.rlike(text, F.lit(word(c))).cast("int") * w for c, w in cues if w > 0]
        scored.append(F.struct((-reduce(add, weights)).alias("key"), F.lit(order).alias("order"), F.lit(family).alias("family")))
    kept = F.array_sort(F.filter(F.array(*scored), lambda s: s["key"] <= -least))
    return F.transform(F.slice(kept, 1, most), lambda s: s["family"])


def _lookup(table: dict) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), _strings(v))])


def family_terms(families: Column | str) -> Column:
    """The terms of the families, each once."""
    terms = _lookup(L.FAMILY_TERMS)
    return first_by_lower(F.flatten(F.transform(col(families), lambda f: F.coalesce(F.try_element_at(terms, F.upper(f)), _strings([])))))


def issue_groups(query: Column | str, families: Column | str, most: int = 4) -> Column:
    """Issue rules of the families with a cue in the query; most hits first, equal hits by name downwards."""
    text = F.lower(F.coalesce(col(query), F.lit("")))
    rules = [
        F.struct(_hits(text, cues).alias("hits"), F.lit(f"{family}:{name}").alias("name"), F.lit(family).alias("family"))
        for family, group in L.ISSUE_RULES.items()
        for name, cues, _ in group
    ]
    found = F.filter(F.array(*rules), lambda r: (r["hits"] > 0) & F.array_contains(col(families), r["family"]))
    return F.transform(F.slice(F.reverse(F.array_sort(found)), 1, most), lambda r: r["name"])


def issue_terms(groups: Column | str, most: int = 16) -> Column:
    """The terms of the groups, each once, cut at ``most``."""
    terms = _lookup({f"{family}:{name}": t for family, group in L.ISSUE_RULES.items() for name, _, t in group})
    return F.slice(first_by_lower(F.flatten(F.transform(col(groups), lambda g: F.try_element_at(terms, g)))), 1, most)


def german_keywords(clean: Column | str, lexicon: dict) -> Column:
    """German words for the English keys that stand in the query, each once, in lexicon order."""
    clean = col(clean)
    padded = F.concat(F.lit(" "), clean, F.lit(" "))
    hits = []
    for key, words in lexicon.items():
        there = F.contains(padded, F.lit(f" {key} "))
        if " " in key:
            there = there | F.contains(clean, F.lit(key))
        hits.append(F.when(there, _strings(words)).otherwise(_strings([])))
    return F.array_distinct(F.flatten(F.array(*hits)))


def german_view(words: Column, snippets, numbers: Column | str, most: int = 8, always: bool = False) -> Column:
    """German words, standing phrases (always, or only beside words), numbered patterns."""
    standing = _strings(snippets) if always else F.when(F.size(words) > 0, _strings(snippets)).otherwise(_strings([]))
    return joined(words, standing, F.transform(F.slice(col(numbers), 1, most), F.lower))


def signal_count(text: Column, signals: dict[str, str]) -> Column:
    """Matches of all patterns."""
    return reduce(add, [F.regexp_count(text, F.lit(p)) for p in signals.values()])


def signal_names(text: Column, signals: dict[str, str]) -> Column:
    return F.filter(F.array(*[F.when(F.rlike(text, F.lit(p)), F.lit(n)) for n, p in signals.items()]), lambda n: n.isNotNull())


def routed_text(query: Column | str, numbers: Column | str) -> Column:
    return joined(F.coalesce(col(query), F.lit("")), F.array_join(col(numbers), " "))


def route(text: Column) -> Column:
    """Which sources to search, from counts of case and statute signals."""
    case, statute = signal_count(text, L.CASE_SIGNALS), signal_count(text, L.STATUTE_SIGNALS)
    label = F.when((case > 0) & (statute > 0), "hybrid").when(case > 0, "court").when(statute > 0, "laws").otherwise("hybrid")
    sure = F.when((case > 0) & (statute > 0), F.when(case + statute >= 3, "high").otherwise("medium"))
    sure = sure.when(case + statute == 0, "low").when(case + statute >= 2, "high").otherwise("medium")
    return F.struct(label.alias("route"), sure.alias("confidence"), case.alias("case_signals"), statute.alias("statute_signals"))


def route_scored(text: Column) -> Column:
    """As ``route``, with a bonus for several kinds of case signal, and hybrid where neither side leads clearly."""
    case_hits, statute_hits = signal_count(text, L.CASE_SIGNALS), signal_count(text, L.STATUTE_SIGNALS)
    case = case_hits + F.when(F.size(signal_names(text, L.CASE_SIGNALS)) >= 2, 1).otherwise(0)
    mixed = F.least(case, statute_hits)
    court = (case >= 2) & (case - statute_hits >= 1)
    laws = (statute_hits >= 2) & (statute_hits - case >= 1)
    label = F.when(mixed >= 1, "hybrid").when(court, "court").when(laws, "laws").otherwise("hybrid")
    sure = F.when(mixed >= 1, F.when(mixed >= 2, "high").otherwise("medium")).when(court | laws, F.when(F.greatest(case, statute_hits) >= 3, "high").otherwise("medium")).otherwise("low")
    return F.struct(label.alias("route"), sure.alias("confidence"), case.cast("double").alias("case_score"), statute_hits.cast("double").alias("statute_score"), mixed.cast("double").alias("mixed_score"))


def quotas(route_label: Column | str, sparse_floor: int = 20, dense_floor: int = 20) -> Column:
    """how many hits each branch may keep, by route; a floor stays with the other source."""
    f, g = min(max(sparse_floor, 0), 60), min(max(dense_floor, 0), 40)
    shares = {"laws": (120 - f, f, 80 - g, g), "court": (f, 120 - f, g, 80 - g), "hybrid": (60, 60, 40, 40)}
    names = ("laws_sparse", "court_sparse", "laws_dense", "court_dense")

    def pick(i: int) -> Column:
        return F.when(col(route_label) == "laws", shares["laws"][i]).when(col(route_label) == "court", shares["court"][i]).otherwise(shares["hybrid"][i])

    return F.struct(*[pick(i).alias(n) for i, n in enumerate(names)])

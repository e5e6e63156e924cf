"""Citation and query text as column expressions: everything here stays inside the JVM."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.functions import lexicons as L

#: Full-width forms and their ASCII counterparts, by rule; no-break space and curly quotes.
WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　\xa0’`"
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + "  ''"
BLANKS = r"[\s\x0b]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c: Column | str) -> Column:
    """NULL to '', compatibility forms folded, blanks collapsed. ``normalize_text_exact`` knows all of NFKC."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(col(c), F.lit("")), WIDE, NARROW), BLANKS, " "))


def normalize_text_exact(c: Column | str) -> Column:
    """N1 with full NFKC, by Arrow batches; for text beyond the forms that ``normalize_text`` folds."""
    return normalize_text(F.pandas_udf(_nfkc, "string")(F.coalesce(col(c), F.lit(""))))


def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def normalize_citation(c: Column | str) -> Column:
    """N1 without end marks, with closed-up labels, without letters and items below the paragraph."""
    out = F.regexp_replace(normalize_text(c), "[;,，。]+$", "")
    for label in ("Art", "Abs", "E"):
        out = F.regexp_replace(out, rf"\b{label}\s+\.", f"{label}.")
    out = F.regexp_replace(out, r"(?i)\s+lit\.?\s+[a-z]\b", "")
    out = F.regexp_replace(out, r"(?i)\s+Ziff\.?\s+[0-9a-z.]+\b", "")
    return F.trim(F.regexp_replace(out, BLANKS, " "))


def split_citations(c: Column | str) -> Column:
    """The non-empty normalised values of a semicolon list; order and repetitions stay."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), ";"), normalize_citation), lambda x: x != "")


def tokens(c: Column | str) -> Column:
    """Maximal runs of letters and digits, in small letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def clean_query(c: Column | str) -> Column:
    """Small letters, plain quotes and dashes, only a-z, digits and ``_./#-`` kept."""
    out = F.translate(F.lower(F.coalesce(col(c), F.lit(""))), "’`–—", "''--")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9_./#\-\s]", " "), BLANKS, " "))


def first_by_lower(array: Column) -> Column:
    """Distinct strings by their small letters, the first spelling kept, order kept."""
    lowered = F.transform(array, F.lower)
    return F.filter(array, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def matches(c: Column | str, patterns: tuple[str, ...]) -> Column:
    """All matches of the patterns, pattern by pattern."""
    text = F.coalesce(col(c), F.lit(""))
    return F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(p), 0), lambda x: F.trim(x)) for p in patterns]))


def number_patterns(c: Column | str) -> Column:
    """N6."""
    return first_by_lower(matches(c, L.NUMBER_PATTERNS))


def rule_patterns(c: Column | str) -> Column:
    """A query with any of these is explicit."""
    return first_by_lower(matches(c, L.RULE_PATTERNS))


def keywords(clean: Column | str, limit: int = 24) -> Column:
    """Tokens of three letters or more that are no stop words, first occurrences."""
    words = F.regexp_extract_all(col(clean), F.lit(r"[a-z0-9_./#-]+"), 0)
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*L.STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, limit)


def legal_phrases(clean: Column | str, words: Column | str, numbers: Column | str) -> Column:
    """Known phrases, two windows of four keywords, the first eight numbered patterns."""
    words, none = col(words), F.array().cast("array<string>")
    known = F.filter(F.array(*[F.lit(p) for p in L.LEGAL_PHRASES]), lambda p: F.contains(col(clean), p))
    windows = [F.when(F.size(words) >= n + 4, F.array(F.array_join(F.slice(words, n + 1, 4), " "))).otherwise(none) for n in (0, 4)]
    numbered = F.transform(F.slice(col(numbers), 1, 8), F.lower)
    return F.array_distinct(F.filter(F.transform(F.concat(known, *windows, numbered), lambda x: F.trim(x)), lambda p: p != ""))


def joined(*parts: Column) -> Column:
    return F.trim(F.concat_ws(" ", *parts))


def sparse_view(clean: Column | str, words: Column | str, numbers: Column | str) -> Column:
    """N10."""
    return joined(col(clean), F.slice(col(words), 1, 12), F.slice(col(numbers), 1, 8))


def dense_view(clean: Column | str, phrases: Column | str) -> Column:
    """N10."""
    return joined(col(clean), F.slice(col(phrases), 1, 8))


def title_template(c: Column | str) -> Column:
    """The head of a title with numbers masked, so that titles from one mould agree."""
    head = F.split(reduce(lambda x, ab: F.replace(x, F.lit(ab[0]), F.lit(ab[1])), (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")), F.lower(F.coalesce(col(c), F.lit("")))), " - ")[0]
    head = F.regexp_replace(F.regexp_replace(head, r"\([^)]*\)", " "), r"\b\d{1,4}\b", " <num> ")
    return F.trim(F.regexp_replace(F.regexp_replace(head, r"[^a-z0-9<>\s]", " "), BLANKS, " "))


def _words(c: Column | str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(pattern), 0), lambda w: F.upper(F.replace(w, F.lit("-"), F.lit(""))))


_NAME = r"\b[A-Za-z][A-Za-z0-9-]{1,12}\b"


def _edge(words: Column, known: tuple[str, ...], at: int) -> Column:
    return F.try_element_at(F.filter(words, lambda w: w.isin(*[k.upper() for k in known])), F.lit(at))


def family_or_last(c: Column | str) -> Column:
    """Last word among the ten known families, else the last word."""
    words = F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"[A-Za-z]{2,8}"), 0), F.upper)
    return F.coalesce(_edge(words, L.FAMILIES_LAST, -1), F.try_element_at(words, F.lit(-1)), F.lit(""))


def family_last(c: Column | str) -> Column:
    """Last name among the families of the rule branch."""
    return F.coalesce(_edge(_words(c, _NAME), L.FAMILIES_RULE, -1), F.lit(""))


def family_first(c: Column | str) -> Column:
    """First name among the twelve supported families."""
    return F.coalesce(_edge(_words(c, _NAME), L.FAMILIES_FIRST, 1), F.lit(""))


def citation_tokens(c: Column | str) -> Column:
    """Structural words, family codes and short numbers of a citation, each once."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    structure = F.regexp_extract_all(text, F.lit(r"\b(?:art|abs|lit|ziff?|para|section|article)\b"), 0)
    families = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\b[a-z]{2,8}\b"), 0), F.upper), lambda w: w.isin(*L.FAMILIES_LAST))
    return F.array_distinct(F.concat(structure, families, F.regexp_extract_all(text, F.lit(r"\b\d{1,4}\b"), 0)))


def paragraph_key(norm: Column | str) -> Column:
    """N34 over a normalised citation: article and family alone for statutes, the whole citation for decisions."""
    pattern = r"(?i)\bArt\.?\s*(\d+[a-z]?)(?:\s*Abs\.?\s*\d+[a-z]?)?(?:\s*lit\.?\s*[a-z])?(?:\s+([A-Za-z]{2,10}))?"
    named = r"(?i)\b(" + "|".join(L.FAMILIES_PARAGRAPH) + r")\b"
    norm = col(norm)
    family = F.coalesce(F.nullif(F.regexp_extract(norm, pattern, 2), F.lit("")), F.nullif(F.regexp_extract(norm, named, 1), F.lit("")), F.lit("UNK"))
    statute = F.concat(F.lit("STATUTE::"), F.upper(family), F.lit("::ART::"), F.upper(F.regexp_extract(norm, pattern, 1)))
    return F.when(norm == "", "").when(F.regexp_extract(norm, pattern, 1) != "", statute).otherwise(F.concat(F.lit("EXACT::"), norm))


def pattern_share(patterns: Column, citation: Column) -> Column:
    """Share of the patterns that the citation holds; two texts that both speak of articles or paragraphs count too."""
    text, structural = F.lower(citation), "art|abs|lit|ziff|para|section"
    met = F.size(F.filter(patterns, lambda p: (F.trim(p) != "") & (F.contains(text, F.lower(F.trim(p))) | (F.rlike(F.lower(p), F.lit(structural)) & F.rlike(text, F.lit(structural))))))
    return F.when(F.size(patterns) > 0, met / F.size(patterns)).otherwise(0.0)


def error_taxonomy(f1: Column, precision: Column, recall: Column, missing: Column) -> Column:
    """First label that applies."""
    return (
        F.when((f1 == 0) & (precision == 0) & (recall == 0), "total_miss")
        .when((missing > 0) & (recall < 0.3), "out_of_corpus_label")
        .when((recall < 0.3) & (precision >= 0.3), "low_recall")
        .when((precision < 0.3) & (recall >= 0.3), "low_precision")
        .when(f1 < 0.4, "both_weak")
        .otherwise("stable")
    )


def explicit_families(query: Column | str) -> Column:
    """Families that the query names by code or by the English name of a code, in the order of the lists."""
    text = F.coalesce(col(query), F.lit(""))
    coded = [F.when(F.rlike(text, F.lit(rf"(?i)\b{f}\b")), F.lit(f)) for f in L.FAMILIES_FIRST]
    named = [F.when(F.rlike(text, F.lit(p)), F.lit(f)) for f, p in L.CODE_NAMES]
    return F.array_distinct(F.filter(F.array(*coded, *named), lambda f: f.isNotNull()))


def plain_citations(c: Column | str) -> Column:
    """Articles that a text names, without letters and items, each once, sorted."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(L.PLAIN_ARTICLE), 0)
    bare = F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\s+lit\.\s+[a-z]+", ""), r"\s+Ziff\.\s+\d+", ""), BLANKS, " ")))
    return F.array_sort(F.array_distinct(bare))


def numbered_law(c: Column | str) -> Column:
    """A citation without letters and items, with the numbers of the laws for their names."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+lit\.\s+[a-z]+", ""), r"\s+Ziff\.\s+\d+", "")
    return F.trim(reduce(lambda x, ab: F.replace(x, F.lit(ab[0]), F.lit(ab[1])), L.SR_NUMBERS.items(), out))


def language_gap(query: Column | str) -> Column:
    """More than 0.6 of the characters are letters a to z: a question in English against texts in other languages."""
    text = F.lower(F.coalesce(col(query), F.lit("")))
    return F.length(F.regexp_replace(text, "[^a-z]", "")) / F.greatest(F.length(text), F.lit(1)) > 0.6

"""The text functions as DuckDB SQL, for the comparison queries."""

from __future__ import annotations

from citeweave.functions import lexicons as L
from citeweave.functions.text import NARROW, WIDE
from citeweave.functions.understanding import word


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm_text(x: str) -> str:
    return f"trim(regexp_replace(translate(coalesce({x}, ''), {q(WIDE)}, {q(NARROW)}), '[\\s\\x0b]+', ' ', 'g'))"


def norm(x: str) -> str:
    out = f"regexp_replace({norm_text(x)}, '[;,，。]+$', '', 'g')"
    for label in ("Art", "Abs", "E"):
        out = f"regexp_replace({out}, '\\b{label}\\s+\\.', '{label}.', 'g')"
    out = f"regexp_replace({out}, '(?i)\\s+lit\\.?\\s+[a-z]\\b', '', 'g')"
    out = f"regexp_replace({out}, '(?i)\\s+Ziff\\.?\\s+[0-9a-z.]+\\b', '', 'g')"
    return f"trim(regexp_replace({out}, '[\\s\\x0b]+', ' ', 'g'))"


def split(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), ';'), lambda v: {norm('v')}), lambda v: v <> '')"


def clean(x: str) -> str:
    base = f"translate(lower(coalesce({x}, '')), '’`–—', '''''--')"
    return f"trim(regexp_replace(regexp_replace({base}, '[^a-z0-9_./#\\-\\s]', ' ', 'g'), '[\\s\\x0b]+', ' ', 'g'))"


def bounded(x: str) -> str:
    """Letters beyond ASCII as underscores: DuckDB's word borders know ASCII only, and no pattern takes such a letter."""
    return f"regexp_replace(coalesce({x}, ''), '[À-ÖØ-öø-ÿ]', '_', 'g')"


def matches(x: str, patterns) -> str:
    lists = ", ".join(f"list_transform(regexp_extract_all({bounded(x)}, {q(p)}), lambda v: trim(v))" for p in patterns)
    return f"flatten([{lists}])"


def first_by_lower(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position(list_transform({x}, lambda w: lower(w)), lower(v)) = i)"


def distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def hits(x: str, cues) -> str:
    return " + ".join(f"CAST(regexp_matches({x}, {q(word(c))}) AS INTEGER)" for c in cues)


def signals(x: str, table: dict) -> str:
    return " + ".join(f"len(regexp_extract_all({bounded(x)}, {q(p)}))" for p in table.values())


def title_template(x: str) -> str:
    head = f"string_split(replace(replace(replace(replace(lower(coalesce({x}, '')), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), ' - ')[1]"
    head = f"regexp_replace(regexp_replace({head}, '\\([^)]*\\)', ' ', 'g'), '\\b\\d{{1,4}}\\b', ' <num> ', 'g')"
    return f"trim(regexp_replace(regexp_replace({head}, '[^a-z0-9<>\\s]', ' ', 'g'), '[\\s\\x0b]+', ' ', 'g'))"


def in_list(words) -> str:
    return "(" + ", ".join(q(w.upper()) for w in words) + ")"


def names(x: str, pattern: str = "\\b[A-Za-z][A-Za-z0-9-]{1,12}\\b") -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '{pattern}'), lambda v: upper(replace(v, '-', '')))"


def edge(words: str, known, at: int) -> str:
    return f"list_filter({words}, lambda v: v IN {in_list(known)})[{at}]"


def family_first(x: str) -> str:
    return f"coalesce({edge(names(x), L.FAMILIES_FIRST, 1)}, '')"


def family_last(x: str) -> str:
    return f"coalesce({edge(names(x), L.FAMILIES_RULE, -1)}, '')"


def family_or_last(x: str) -> str:
    words = names(x, "[A-Za-z]{2,8}")
    return f"coalesce({edge(words, L.FAMILIES_LAST, -1)}, {words}[-1], '')"


def paragraph_key(x: str) -> str:
    pattern = q(r"(?i)\bArt\.?\s*(\d+[a-z]?)(?:\s*Abs\.?\s*\d+[a-z]?)?(?:\s*lit\.?\s*[a-z])?(?:\s+([A-Za-z]{2,10}))?")
    named = q(r"(?i)\b(" + "|".join(L.FAMILIES_PARAGRAPH) + r")\b")
    family = f"coalesce(nullif(regexp_extract({x}, {pattern}, 2), ''), nullif(regexp_extract({x}, {named}, 1), ''), 'UNK')"
    return (
        f"CASE WHEN {x} = '' THEN '' WHEN regexp_extract({x}, {pattern}, 1) <> '' "
        f"THEN 'STATUTE::' || upper({family}) || '::ART::' || upper(regexp_extract({x}, {pattern}, 1)) ELSE 'EXACT::' || {x} END"
    )


CORPUS = f"""
    corpus AS (
        SELECT *, {norm('citation')} AS norm FROM (
            SELECT 'laws_de' AS source, row_id, coalesce(citation, '') AS citation, coalesce(title, '') AS title, coalesce(text, '') AS text FROM laws_de
            UNION ALL
            SELECT 'court_considerations', row_id, coalesce(citation, ''), '', coalesce(text, '') FROM court_considerations))"""

QUESTIONS = """
    questions AS (
        SELECT query_id, row_id, trim(coalesce(query, '')) AS query, gold_citations AS gold FROM val WHERE query_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY row_id DESC) = 1)"""

GOLD = f"{QUESTIONS}, gold AS (SELECT DISTINCT query_id, unnest({split('gold')}) AS citation FROM questions)"

TRACE = """
    trace AS (
        SELECT * FROM val_seed_trace_silver_baseline_v0 WHERE query_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY row_id DESC) = 1)"""


def ranked(name: str, column: str) -> str:
    inner = distinct("l")
    return f"""
    {name}_lists AS (SELECT query_id, {split(column)} AS l FROM trace),
    {name} AS (SELECT query_id, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS rank, unnest(l) AS citation FROM (SELECT query_id, {inner} AS l FROM {name}_lists))"""


HITS = """
    hits AS (
        SELECT query_id, method AS list_id, source, citation, max(score) AS score FROM retrieved_item
        WHERE query_id IS NOT NULL AND citation IS NOT NULL AND method IS NOT NULL AND source IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
        GROUP BY ALL)"""

VIEWS = f"""
    base AS (SELECT query_id, row_id, query, {clean('query')} AS clean, {matches('query', L.NUMBER_PATTERNS)} AS all_numbers FROM questions),
    based AS (SELECT *, {first_by_lower('all_numbers')} AS numbers,
        list_filter(regexp_extract_all(clean, '[a-z0-9_./#-]+'), lambda w: length(w) >= 3 AND w NOT IN ({', '.join(q(w) for w in L.STOPWORDS)})) AS all_words FROM base),
    worded AS (SELECT * EXCLUDE (all_words, all_numbers), {distinct('all_words')}[1:24] AS words FROM based),
    phrased AS (SELECT *, list_filter(flatten([
            list_filter([{', '.join(q(p) for p in L.LEGAL_PHRASES)}], lambda p: contains(clean, p)),
            CASE WHEN len(words) >= 4 THEN [array_to_string(words[1:4], ' ')] ELSE [] END,
            CASE WHEN len(words) >= 8 THEN [array_to_string(words[5:8], ' ')] ELSE [] END,
            list_transform(numbers[1:8], lambda v: lower(v))]), lambda p: trim(p) <> '') AS all_phrases FROM worded),
    views AS (SELECT * EXCLUDE (all_phrases), {distinct('all_phrases')} AS phrases FROM phrased)"""

FAMILIES = (
    "family_scores AS ("
    + " UNION ALL ".join(
        f"SELECT query_id, {q(f)} AS family, {n} AS ord, " + " + ".join(f"{w} * CAST(regexp_matches(lower(query), {q(word(c))}) AS INTEGER)" for c, w in cues if w > 0) + " AS score FROM questions"
        for n, (f, cues) in enumerate(L.FAMILY_CUES.items())
    )
    + "), likely AS (SELECT query_id, family, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS INTEGER) AS rank FROM family_scores "
    "WHERE score >= 4 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) <= 2)"
)

ISSUES = (
    "issue_hits AS ("
    + " UNION ALL ".join(
        f"SELECT q.query_id, {q(f + ':' + name)} AS name, {hits('lower(q.query)', cues)} AS hits FROM questions q JOIN likely l ON l.query_id = q.query_id AND l.family = {q(f)}"
        for f, rules in L.ISSUE_RULES.items()
        for name, cues, _ in rules
    )
    + "), issues AS (SELECT query_id, name, hits, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, name DESC) AS INTEGER) AS rank FROM issue_hits WHERE hits > 0 "
    "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, name DESC) <= 4), issue_words(name, ord, term) AS (VALUES "
    + ", ".join(f"({q(f + ':' + name)}, {n}, {q(t)})" for f, rules in L.ISSUE_RULES.items() for name, _, terms in rules for n, t in enumerate(terms))
    + ")"
)


def german(name: str, lexicon: dict, source: str = "views") -> str:
    """German keywords of a lexicon, each once, in lexicon order: query_id, pos, word."""
    rows = ", ".join(f"({i}, {j}, {q(k)}, {q(w)})" for i, (k, ws) in enumerate(lexicon.items()) for j, w in enumerate(ws))
    return f"""
    {name}_lex(i, j, key, word) AS (VALUES {rows}),
    {name}_hit AS (SELECT query_id, word, min(i * 100 + j) AS pos FROM {source}, {name}_lex
        WHERE contains(' ' || clean || ' ', ' ' || key || ' ') OR (contains(key, ' ') AND contains(clean, key)) GROUP BY ALL),
    {name} AS (SELECT query_id, string_agg(word, ' ' ORDER BY pos) AS words FROM {name}_hit GROUP BY query_id)"""


ROUTED = "routed AS (SELECT query_id, trim(concat_ws(' ', query, array_to_string(numbers, ' '))) AS text FROM views)"

"""The evaluation queries as DuckDB SQL."""

from __future__ import annotations

from citeweave.functions import lexicons as L
from citeweave.plans import sql_text as S
from citeweave.plans.evaluation_queries import BRANCHES
from citeweave.plans.retrieval_queries import _LISTS
from citeweave.plans.text_queries import SQL as TEXT

_CORPUS = f"WITH {S.CORPUS}"
LOOKUP = """
    lookup AS (SELECT norm, arg_min(citation, {'n': length(citation), 'c': citation}) AS canonical, count(*) AS n_rows FROM corpus WHERE norm <> '' GROUP BY norm)"""
SOURCES = """
    both_forms AS (SELECT source, row_id, unnest([citation, norm]) AS citation FROM corpus),
    source_map AS (SELECT citation, arg_max(source, {'o': CAST(source = 'court_considerations' AS INTEGER), 'r': row_id}) AS source FROM both_forms GROUP BY citation)"""
DOCS = """
    docs AS (SELECT norm, arg_max({'source': source, 'row_id': row_id, 'title': title, 'text': text}, {'o': CAST(source = 'court_considerations' AS INTEGER), 'r': row_id}) AS d FROM corpus WHERE norm <> '' GROUP BY norm)"""
NORMS = "norms AS (SELECT DISTINCT norm AS citation FROM corpus WHERE norm <> '')"
PRED = f"{S.TRACE}, {S.ranked('pred', 'final_predictions')}"
CAND = f"{S.TRACE}, {S.ranked('cand', 'fused_top200')}"
KNOWN = "known AS (SELECT * FROM gold SEMI JOIN norms USING (citation))"
KS = (10, 50, 100, 200)


def f1(name: str, gold: str, pred: str, missing: str = "0", empty: str = "0.0") -> str:
    """Counts and scores of gold(query_id, citation) against pred(query_id, citation) for all questions."""
    return f"""
    {name}_g AS (SELECT query_id, count(DISTINCT citation) AS g FROM {gold} GROUP BY ALL), {name}_p AS (SELECT query_id, count(DISTINCT citation) AS p FROM {pred} GROUP BY ALL),
    {name}_t AS (SELECT query_id, count(*) AS tp FROM (SELECT DISTINCT query_id, citation FROM {gold}) JOIN (SELECT DISTINCT query_id, citation FROM {pred}) USING (query_id, citation) GROUP BY ALL),
    {name}_n AS (SELECT query_id, coalesce(g, 0) AS g, coalesce(p, 0) AS p, coalesce(tp, 0) AS tp FROM questions LEFT JOIN {name}_g USING (query_id) LEFT JOIN {name}_p USING (query_id) LEFT JOIN {name}_t USING (query_id)),
    {name} AS (SELECT query_id, g AS gold_count, p AS pred_count, tp, p - tp AS fp, g - tp AS fn,
        CASE WHEN g = 0 AND p = 0 THEN {empty} WHEN p > 0 THEN tp / p ELSE 0.0 END AS precision, CASE WHEN g = 0 AND p = 0 THEN {empty} WHEN g > 0 THEN tp / g ELSE 0.0 END AS recall,
        CASE WHEN g = 0 AND p = 0 THEN {empty} WHEN g + p > 0 THEN 2.0 * tp / (g + p) ELSE 0.0 END AS f1, {missing} AS missing_gold FROM {name}_n)"""


_ROUND = "SELECT query_id, gold_count, pred_count, tp, fp, fn, round(CAST(precision AS DOUBLE), 6) AS precision, round(CAST(recall AS DOUBLE), 6) AS recall, round(CAST(f1 AS DOUBLE), 6) AS f1, CAST(missing_gold AS BIGINT) AS missing_gold FROM"
_STRICT = f"WITH {S.GOLD}, {PRED}, {f1('strict', 'gold', 'pred')}"
_AWARE = f"""WITH {S.CORPUS}, {LOOKUP}, {S.GOLD}, {PRED}, gk AS (SELECT query_id, citation AS raw, canonical FROM gold LEFT JOIN lookup ON norm = citation),
    gold_c AS (SELECT query_id, canonical AS citation FROM gk WHERE canonical IS NOT NULL), pred_c AS (SELECT query_id, coalesce(canonical, citation) AS citation FROM pred LEFT JOIN lookup ON norm = citation),
    miss AS (SELECT query_id, count(*) FILTER (WHERE canonical IS NULL) AS m FROM gk GROUP BY ALL), {f1('aware0', 'gold_c', 'pred_c')},
    aware AS (SELECT a.* REPLACE (coalesce(m, 0) AS missing_gold) FROM aware0 a LEFT JOIN miss USING (query_id))"""
_TAXONOMY = """CASE WHEN f1 = 0 AND precision = 0 AND recall = 0 THEN 'total_miss' WHEN missing_gold > 0 AND recall < 0.3 THEN 'out_of_corpus_label' WHEN recall < 0.3 AND precision >= 0.3 THEN 'low_recall'
    WHEN precision < 0.3 AND recall >= 0.3 THEN 'low_precision' WHEN f1 < 0.4 THEN 'both_weak' ELSE 'stable' END"""
_RECALLS = ", ".join(f"round(CAST(count(*) FILTER (WHERE rank <= {k}) AS DOUBLE) / count(*), 6) AS recall_at_{k}" for k in KS)
_BRANCH_VALUES = ", ".join(f"({S.q(b)})" for b in BRANCHES)
_BRANCH = f"""WITH {S.CORPUS}, {NORMS}, {S.GOLD}, {KNOWN}, {_LISTS}, br(list_id) AS (VALUES {_BRANCH_VALUES}),
    best_rank AS (SELECT query_id, list_id, citation, min(rank) AS rank FROM lists GROUP BY ALL),
    branch_ranks AS (SELECT k.query_id, br.list_id, k.citation, b.rank FROM known k CROSS JOIN br LEFT JOIN best_rank b ON b.query_id = k.query_id AND b.list_id = br.list_id AND b.citation = k.citation),
    branch_recall AS (SELECT query_id, list_id, {_RECALLS}, coalesce(min(rank), -1) AS first_hit_rank FROM branch_ranks GROUP BY ALL)"""
_GOLD_SOURCES = f"""{S.CORPUS}, {SOURCES}, {S.GOLD}, gs0 AS (SELECT query_id, source FROM gold LEFT JOIN source_map USING (citation)),
    gs1 AS (SELECT query_id, coalesce(bool_or(source = 'laws_de'), false) AS l, coalesce(bool_or(source = 'court_considerations'), false) AS c, bool_or(source IS NULL) AS o, count(source) AS gold_known FROM gs0 GROUP BY ALL),
    gold_sources AS (SELECT query_id, CASE WHEN l AND NOT c AND NOT o THEN 'laws_only' WHEN c AND NOT l AND NOT o THEN 'court_only' WHEN NOT l AND NOT c THEN 'unknown' ELSE 'mixed' END AS gold_source, gold_known FROM gs1)"""


def _failures(source: str, other: str) -> str:
    return f"""SELECT s.query_id, '{source}' AS branch, CASE WHEN gold_known = 0 THEN 'no_gold_in_candidates' WHEN gold_source = '{other}' THEN 'source_mismatch'
        WHEN count(*) FILTER (WHERE rank <= 200) = 0 THEN 'no_gold_in_candidates' WHEN coalesce(min(rank), -1) > 50 THEN 'gold_only_after_large_k' ELSE 'ok' END AS failure
        FROM gold_sources s JOIN gold g ON g.query_id = s.query_id LEFT JOIN (SELECT query_id, citation, min(rank) AS rank FROM lists WHERE list_id = 'sparse_text' AND source = '{source}' GROUP BY ALL) b
        ON b.query_id = g.query_id AND b.citation = g.citation GROUP BY s.query_id, gold_known, gold_source"""


_FAILURES = f"WITH {_GOLD_SOURCES}, {_LISTS}, failures AS ({_failures('laws_de', 'court_only')} UNION ALL {_failures('court_considerations', 'laws_only')})"

_TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_CANDIDATES = f"""WITH {S.CORPUS}, {DOCS}, {S.QUESTIONS}, {S.VIEWS}, {S.FAMILIES}, {_LISTS}, fam AS (SELECT query_id, list(family) AS families FROM likely GROUP BY query_id),
    rrf AS (SELECT query_id, citation, round(sum(1.0 / (60.0 + rank)), 6) AS fused_score FROM lists GROUP BY ALL),
    fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, citation) AS INTEGER) AS fused_rank FROM rrf QUALIFY fused_rank <= 50),
    flags AS (SELECT query_id, citation, max(CAST(list_id = 'rule_exact' AS INTEGER)) AS is_rule, max(CAST(list_id = 'sparse_title' AS INTEGER)) AS is_issue,
        max(CAST(list_id = 'sparse_text' AS INTEGER)) AS s, max(CAST(list_id = 'dense_multi_view' AS INTEGER)) AS v, min(source) AS hit_source FROM lists GROUP BY ALL),
    c0 AS (SELECT f.query_id, q.query, f.citation, coalesce(docs.d.source, hit_source) AS source, trim(concat_ws(' ', f.citation, coalesce(docs.d.title, ''), coalesce(docs.d.text, ''))) AS body,
        fused_score, fused_rank, is_rule, is_issue, s * v AS is_both, CASE WHEN v = 1 AND s + is_rule + is_issue = 0 THEN 1 ELSE 0 END AS is_dense_only,
        CAST(coalesce(list_contains(coalesce(families, []), nullif({S.family_first('f.citation')}, '')), false) AS INTEGER) AS is_family,
        len({S.first_by_lower(S.matches('q.query', L.RULE_PATTERNS))}) > 0 AS explicit
        FROM fused f JOIN flags USING (query_id, citation) LEFT JOIN docs ON docs.norm = f.citation JOIN questions q ON q.query_id = f.query_id LEFT JOIN fam ON fam.query_id = f.query_id)"""
_RERANKED = f"""{_CANDIDATES}, scored AS (SELECT *, round(fused_score + 0.02::DOUBLE * len(list_distinct(list_intersect({_TOKENS.format('query')}, {_TOKENS.format('body')})))
        + CASE source WHEN 'laws_de' THEN 0.005::DOUBLE ELSE 0.0::DOUBLE END, 6) AS rerank_score FROM c0),
    reranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank, citation) AS INTEGER) AS rerank_rank FROM scored)"""
_CUT = "cut5 AS (SELECT query_id, citation, rerank_rank FROM reranked WHERE rerank_rank <= 5)"
_RESCUE = """rescued AS (SELECT query_id, citation, fused_rank FROM c0 WHERE NOT explicit AND is_family = 1 AND source = 'laws_de' AND NOT EXISTS (SELECT 1 FROM cut5 WHERE cut5.query_id = c0.query_id AND cut5.citation = c0.citation)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) <= 1)"""
_PRIORITY = "is_laws DESC, tier DESC, is_rule DESC, is_family DESC, is_issue DESC, fused_rank, fused_score DESC, citation"
_STRICT_ROWS = f"{S.GOLD}, {PRED}, {f1('strict', 'gold', 'pred')}"
_FIELDS = """raw AS (SELECT query_id, source, citation, replace(list_id, 'sparse_', '') AS field, score FROM hits WHERE list_id IN ('sparse_citation', 'sparse_title', 'sparse_text')),
    parts AS (SELECT query_id, source, citation, coalesce(max(CASE WHEN field = 'citation' THEN score END), 0.0) AS c, coalesce(max(CASE WHEN field = 'title' THEN score END), 0.0) AS t,
        coalesce(max(CASE WHEN field = 'text' THEN score END), 0.0) AS x FROM raw GROUP BY ALL)"""


def _grid(axes: dict[str, list]) -> str:
    """Configs numbered in the order of the axes, the last axis fastest."""
    from itertools import product

    rows = ", ".join("(" + ", ".join([str(i), *[S.q(v) if isinstance(v, str) else f"{v}::DOUBLE" for v in values]]) + ")" for i, values in enumerate(product(*axes.values())))
    return f"grid(config_id, {', '.join(axes)}) AS (VALUES {rows})"


def _recall(rows: str) -> str:
    """rows(config_id, query_id, citation, source, c, t, x) -> mean recall at 100 and 200 by config."""
    return f"""
    best AS (SELECT config_id, query_id, citation, CAST(row_number() OVER (PARTITION BY config_id, query_id ORDER BY round(greatest(c, t, x), 6) DESC, citation, source) AS INTEGER) AS rank FROM {rows} QUALIFY rank <= 200),
    once AS (SELECT config_id, query_id, citation, min(rank) AS rank FROM best JOIN gold USING (query_id, citation) GROUP BY ALL),
    per AS (SELECT config_id, query_id, count(*) FILTER (WHERE rank <= 100) AS h100, count(*) FILTER (WHERE rank <= 200) AS h200 FROM once GROUP BY ALL), tot AS (SELECT query_id, count(*) AS n FROM gold GROUP BY ALL),
    agg AS (SELECT config_id, sum(h100 / n) AS s100, sum(h200 / n) AS s200 FROM per JOIN tot USING (query_id) GROUP BY ALL),
    results AS (SELECT CAST(config_id AS BIGINT) AS config_id, round(coalesce(s100, 0.0) / (SELECT count(*) FROM tot), 6) AS recall_at_100, round(coalesce(s200, 0.0) / (SELECT count(*) FROM tot), 6) AS recall_at_200 FROM grid LEFT JOIN agg USING (config_id))"""


_WEIGHTS = {"w_citation": [1.0, 1.5, 2.0, 3.0], "w_title": [0.5, 1.0, 1.5, 2.0], "w_text": [0.5, 1.0, 1.5, 2.0]}
_WEIGHT_GRID = f"WITH {S.GOLD}, {_LISTS}, {_FIELDS}, {_grid(_WEIGHTS)}, weighed AS (SELECT config_id, query_id, source, citation, c * w_citation AS c, t * w_title AS t, x * w_text AS x FROM parts, grid), {_recall('weighed')}"
_SHARES = f"""tmpl AS (SELECT norm AS citation, row_id, {S.title_template('title')} AS template FROM corpus WHERE source = 'laws_de' AND norm <> ''),
    tshare AS (SELECT template, count(*) / (SELECT count(*) FROM tmpl) AS df_share FROM tmpl GROUP BY template), titled AS (SELECT citation, arg_max(template, row_id) AS template FROM tmpl GROUP BY citation),
    shares AS (SELECT citation, df_share FROM titled JOIN tshare USING (template))"""
_MISS = f"""{_GOLD_SOURCES}, {CAND}, {_LISTS}, {S.VIEWS}, {S.ROUTED},
    br AS (SELECT query_id, bool_or(list_id LIKE 'sparse%') AS sparse, bool_or(list_id LIKE 'dense%') AS dense FROM gold JOIN (SELECT DISTINCT query_id, citation, list_id FROM lists) USING (query_id, citation) GROUP BY ALL),
    hit AS (SELECT query_id, coalesce(bool_or(rank <= 200), false) AS hit FROM gold LEFT JOIN cand USING (query_id, citation) GROUP BY ALL), pool AS (SELECT query_id, count(*) AS pool FROM cand GROUP BY ALL),
    reasons AS (SELECT hit.query_id, CASE WHEN hit THEN 'hit_in_fused_top200' WHEN coalesce(pool, 0) < 200 THEN 'candidate_pool_too_shallow'
        WHEN NOT coalesce(sparse, false) AND NOT coalesce(dense, false) AND (contains(query, 'Art.') OR contains(query, 'BGE') OR contains(query, '_')) THEN 'needs_anchor_rule'
        WHEN NOT coalesce(sparse, false) AND NOT coalesce(dense, false) THEN 'not_retrieved_sparse' WHEN coalesce(sparse, false) AND NOT coalesce(dense, false) THEN 'not_retrieved_dense'
        WHEN coalesce(dense, false) AND NOT coalesce(sparse, false) THEN 'not_retrieved_sparse' ELSE 'lost_in_merge' END AS reason
        FROM hit LEFT JOIN br USING (query_id) LEFT JOIN pool USING (query_id) JOIN views USING (query_id))"""

SQL = {
    "citation_lookup": f"{_CORPUS}, {LOOKUP} SELECT * FROM lookup",
    "source_map": f"{_CORPUS}, {SOURCES} SELECT * FROM source_map",
    "doc_lookup": f"{_CORPUS}, {DOCS} SELECT norm, d.source AS source, d.row_id AS row_id FROM docs",
    "corpus_stats": f"{_CORPUS} SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE norm <> '') AS n_cited, count(DISTINCT nullif(norm, '')) AS n_distinct FROM corpus GROUP BY source",
    "gold_in_corpus": f"{_CORPUS}, {NORMS}, {S.GOLD} SELECT query_id, citation FROM gold SEMI JOIN norms USING (citation)",
    "gold_missing": f"{_CORPUS}, {NORMS}, {S.GOLD} SELECT query_id, citation FROM gold ANTI JOIN norms USING (citation)",
    "gold_canonical": f"{_CORPUS}, {LOOKUP}, {S.GOLD} SELECT DISTINCT query_id, coalesce(canonical, citation) AS citation FROM gold LEFT JOIN lookup ON norm = citation",
    "f1_strict": f"{_STRICT} {_ROUND} strict",
    "f1_corpus_aware": f"{_AWARE} {_ROUND} aware",
    "f1_summary": f"""{_AWARE}, {f1('strict', 'gold', 'pred')} SELECT 'strict' AS mode, count(*) AS queries, round(avg(CAST(f1 AS DOUBLE)), 6) AS macro_f1, round(avg(CAST(missing_gold AS DOUBLE)), 6) AS avg_missing_gold FROM strict
        UNION ALL SELECT 'corpus_aware', count(*), round(avg(CAST(f1 AS DOUBLE)), 6), round(avg(CAST(missing_gold AS DOUBLE)), 6) FROM aware""",
    "error_taxonomy": f"{_AWARE}, r AS ({_ROUND} aware) SELECT {_TAXONOMY} AS label, count(*) AS n FROM r GROUP BY ALL",
    "paragraph_f1": f"""WITH {S.CORPUS}, {NORMS}, {S.GOLD}, {PRED}, {KNOWN}, gp AS (SELECT DISTINCT query_id, {S.paragraph_key('citation')} AS citation FROM gold), pp AS (SELECT DISTINCT query_id, {S.paragraph_key('citation')} AS citation FROM pred),
        {f1('exact', 'gold', 'pred', empty='1.0')}, {f1('loose', 'gp', 'pp', empty='1.0')}
        SELECT e.query_id, round(CAST(e.f1 AS DOUBLE), 6) AS exact_f1, round(CAST(l.f1 AS DOUBLE), 6) AS paragraph_f1, e.query_id NOT IN (SELECT query_id FROM known) AS unreachable FROM exact e JOIN loose l USING (query_id)""",
    "lowest_f1": f"{_STRICT}, r AS ({_ROUND} strict) SELECT query_id, f1 FROM r ORDER BY f1, query_id LIMIT 20",
    "recall_at_k": f"""WITH {S.CORPUS}, {NORMS}, {S.GOLD}, {KNOWN}, {CAND}, r AS (SELECT query_id, {_RECALLS}, coalesce(min(rank), -1) AS first_hit_rank FROM known LEFT JOIN cand USING (query_id, citation) GROUP BY query_id)
        SELECT query_id, {', '.join(f'coalesce(recall_at_{k}, 0.0) AS recall_at_{k}' for k in KS)}, coalesce(first_hit_rank, -1) AS first_hit_rank FROM questions LEFT JOIN r USING (query_id)""",
    "recall_definitions": f"""WITH {S.CORPUS}, {NORMS}, {S.GOLD}, {CAND}, r AS (SELECT g.query_id, rank, n.citation IS NOT NULL AS k FROM gold g LEFT JOIN cand USING (query_id, citation) LEFT JOIN norms n ON n.citation = g.citation),
        per AS (SELECT query_id, count(*) FILTER (WHERE rank <= 200) AS h, count(*) AS n, count(*) FILTER (WHERE k AND rank <= 200) AS hk, count(*) FILTER (WHERE k) AS nk FROM r GROUP BY ALL)
        SELECT round(coalesce(avg(h / n), 0.0), 6) AS macro_all_gold, round(coalesce(avg(CASE WHEN nk > 0 THEN hk / nk END), 0.0), 6) AS macro_in_corpus, round(CAST(sum(h) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS micro,
        round(avg(CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit_rate FROM per""",
    "branch_recall": f"{_BRANCH} SELECT * FROM branch_recall",
    "gold_sources": f"WITH {_GOLD_SOURCES} SELECT * FROM gold_sources",
    "branch_failures": f"{_FAILURES} SELECT * FROM failures",
    "failure_clusters": f"{_FAILURES} SELECT branch, failure, count(*) AS n FROM failures GROUP BY ALL",
    "best_branch": f"""{_BRANCH} SELECT query_id, list_id AS best_branch FROM branch_recall
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY recall_at_200 DESC, recall_at_100 DESC, recall_at_50 DESC, recall_at_10 DESC, list_id) = 1""",
    "branch_means": f"{_BRANCH} " + " UNION ALL ".join(f"SELECT list_id, 'r{k}' AS metric, round(avg(recall_at_{k}), 6) AS value FROM branch_recall GROUP BY list_id" for k in KS),
    "config_compare": f"""{_BRANCH} SELECT a.query_id, a.recall_at_50 AS a_50, b.recall_at_50 AS b_50, round(b.recall_at_50 - a.recall_at_50, 6) AS delta_50, round(b.recall_at_200 - a.recall_at_200, 6) AS delta_200
        FROM branch_recall a JOIN branch_recall b ON a.query_id = b.query_id AND a.list_id = 'sparse_bm25' AND b.list_id = 'sparse_text'""",
    "token_overlap_rerank": f"{_RERANKED} SELECT query_id, citation, rerank_score, rerank_rank FROM reranked",
    "evidence_calibration": f"""{_RERANKED}, cal AS (SELECT *, round(CASE WHEN rerank_rank <= 20 AND source = 'laws_de' THEN rerank_score + (0.08::DOUBLE * is_rule + 0.04::DOUBLE * is_rule + 0.03::DOUBLE * is_family
        + 0.03::DOUBLE * is_issue + 0.05::DOUBLE * is_both - 0.04::DOUBLE * is_dense_only) ELSE rerank_score END, 6) AS calibrated_score FROM reranked)
        SELECT query_id, citation, calibrated_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rerank_rank <= 20 THEN 0 ELSE 1 END, CASE WHEN rerank_rank <= 20 THEN -calibrated_score END, rerank_rank) AS INTEGER) AS calibrated_rank FROM cal""",
    "cut_fixed": f"{_RERANKED}, {_CUT} SELECT * FROM cut5",
    "cut_score": f"""{_RERANKED}, p AS (SELECT *, bool_or(rerank_score >= 0.15) OVER (PARTITION BY query_id) AS any_ FROM reranked)
        SELECT query_id, citation, rerank_rank FROM p WHERE rerank_score >= 0.15 OR (NOT any_ AND rerank_rank <= 5)""",
    "cut_relative": f"""{_RERANKED}, p AS (SELECT *, rerank_score >= max(rerank_score) OVER (PARTITION BY query_id) * 0.85::DOUBLE AS pass FROM reranked), a AS (SELECT *, bool_or(pass) OVER (PARTITION BY query_id) AS any_ FROM p)
        SELECT query_id, citation, rerank_rank FROM a WHERE pass OR (NOT any_ AND rerank_rank <= 5)""",
    "final_rescue": f"{_RERANKED}, {_CUT}, {_RESCUE} SELECT * FROM rescued",
    "final_union": f"""{_RERANKED}, {_CUT}, {_RESCUE}, seg AS (SELECT query_id, citation, rank AS r, 0 AS s FROM lists WHERE list_id = 'rule_exact' AND source = 'laws_de' UNION ALL SELECT query_id, citation, rerank_rank, 1 FROM cut5 UNION ALL SELECT query_id, citation, fused_rank, 2 FROM rescued),
        f AS (SELECT query_id, citation, min(s * 1000000 + r) AS at_ FROM seg GROUP BY ALL) SELECT query_id, citation, CAST(row_number() OVER (PARTITION BY query_id ORDER BY at_, citation) AS INTEGER) AS rank FROM f""",
    "rerank_shaping": f"""{_CANDIDATES}, t AS (SELECT *, CAST(source = 'laws_de' AS INTEGER) AS is_laws, CASE WHEN is_family = 1 AND is_issue = 1 THEN 4 WHEN is_rule = 1 THEN 3 WHEN is_family = 1 THEN 2 WHEN is_issue = 1 THEN 1 ELSE 0 END AS tier FROM c0),
        p AS (SELECT *, is_laws = 1 AND tier > 0 AS first_, row_number() OVER (PARTITION BY query_id, is_laws = 1 AND tier > 0 ORDER BY {_PRIORITY}) AS p FROM t), s AS (SELECT *, CASE WHEN first_ AND p <= 15 THEN 0 ELSE 1 END AS seg FROM p)
        SELECT query_id, citation, tier, CAST(row_number() OVER (PARTITION BY query_id ORDER BY seg, CASE WHEN seg = 0 THEN p END, fused_rank) AS INTEGER) AS input_rank FROM s QUALIFY input_rank <= 30""",
    "admission_audit": f"""{_RERANKED}, gold AS (SELECT DISTINCT query_id, unnest({S.split('gold')}) AS citation FROM questions), {PRED}
        SELECT g.query_id, g.citation, coalesce(fused_rank, -1) AS fused_rank, coalesce(rerank_rank, -1) AS rank_after,
        CASE WHEN p.citation IS NOT NULL THEN 'kept_final' WHEN rerank_rank IS NULL THEN 'not_in_rerank_input' WHEN rerank_rank > 5 THEN 'reranked_too_low' ELSE 'cut_by_dynamic_threshold' END AS drop_stage
        FROM gold g LEFT JOIN reranked r ON r.query_id = g.query_id AND r.citation = g.citation LEFT JOIN pred p ON p.query_id = g.query_id AND p.citation = g.citation""",
    "subset_metrics": f"""WITH {_STRICT_ROWS}, e AS (SELECT s.*, len({S.matches('query', L.RULE_PATTERNS)}) > 0 AS explicit FROM strict s JOIN questions USING (query_id))
        SELECT CASE WHEN grouping(explicit) = 1 THEN 'all' WHEN explicit THEN 'explicit' ELSE 'other' END AS subset, count(*) AS n, round(avg(CAST(f1 AS DOUBLE)), 6) AS macro_f1, CAST(sum(fp) AS BIGINT) AS fp FROM e GROUP BY ROLLUP (explicit)""",
    "miss_reason": f"WITH {_MISS} SELECT * FROM reasons",
    "reason_by_source": f"""WITH {_MISS}, dom(gold_source) AS (VALUES ('laws_only'), ('court_only'), ('mixed'), ('unknown')), r AS (SELECT gold_source, count(*) AS n, count(*) FILTER (WHERE reason = 'hit_in_fused_top200') AS hits FROM reasons JOIN gold_sources USING (query_id) GROUP BY ALL)
        SELECT gold_source, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits FROM dom LEFT JOIN r USING (gold_source)""",
    "tail_rescues": f"{_BRANCH} SELECT query_id, count(*) FILTER (WHERE rank BETWEEN 101 AND 200) AS n_tail FROM branch_ranks WHERE list_id = 'sparse_text' GROUP BY ALL",
    "truncation_audit": f"""WITH {S.CORPUS}, {DOCS}, {S.QUESTIONS}, {S.VIEWS}, gold AS (SELECT DISTINCT query_id, unnest({S.split('gold')}) AS citation FROM questions),
        r AS (SELECT query_id, citation, lower(docs.d.text) AS text, list_min(list_filter(list_transform(list_filter(words, lambda w: length(w) >= 4), lambda w: instr(lower(docs.d.text), w)), lambda p: p > 0)) AS first_
        FROM gold JOIN docs ON docs.norm = citation AND docs.d.source = 'laws_de' JOIN views USING (query_id))
        SELECT query_id, citation, CAST(length(text) AS INTEGER) AS n_chars, CASE WHEN first_ IS NULL THEN 'no_detectable_query_signal' WHEN first_ <= 500 THEN 'within_500' WHEN first_ <= 900 THEN 'within_900' ELSE 'beyond_900' END AS bucket FROM r""",
    "preflight": f"""WITH s AS (SELECT query_id, {S.split('predicted_citations')} AS p FROM submission_baseline_v1 WHERE query_id IS NOT NULL)
        SELECT query_id, count(*) AS n_rows, bool_or(len(p) = 0) AS has_empty, bool_or(len(p) <> len(list_distinct(p))) AS has_repeats FROM s GROUP BY query_id""",
    "route_agreement": f"""WITH {_GOLD_SOURCES}, rec AS (SELECT query_id, arg_max(route_label, row_id) AS route FROM val_seed_trace_silver_baseline_v0 WHERE query_id IS NOT NULL GROUP BY query_id),
        w AS (SELECT route, CASE gold_source WHEN 'laws_only' THEN 'laws' WHEN 'court_only' THEN 'court' ELSE 'hybrid' END AS wanted FROM rec LEFT JOIN gold_sources USING (query_id))
        SELECT wanted, count(*) AS n, count(*) FILTER (WHERE route = wanted) AS agree, count(*) FILTER (WHERE route = 'hybrid' AND wanted <> 'hybrid') AS over_routed FROM w GROUP BY wanted""",
    "weight_grid": f"{_WEIGHT_GRID} SELECT * FROM results",
    "weight_grid_best": f"{_WEIGHT_GRID} SELECT * FROM results ORDER BY recall_at_100 DESC, recall_at_200 DESC, config_id LIMIT 1",
    "title_df_quantile": f"WITH {S.CORPUS}, {_SHARES} " + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, round(coalesce(quantile_disc(df_share, {q}), 1.0), 6) AS threshold FROM shares" for q in (0.90, 0.95, 0.97, 0.99)),
    "penalty_grid": f"""WITH {S.CORPUS}, {_SHARES}, {S.GOLD}, {_LISTS}, {_FIELDS}, {_grid({'mode': ['df_only', 'df_plus_dominance'], 'strength': [0.3, 0.6]})},
        w0 AS (SELECT config_id, mode, strength, query_id, source, citation, c * 2.0::DOUBLE AS c, t * 2.0::DOUBLE AS t, x * 1.0::DOUBLE AS x, coalesce(df_share, 0.0) AS df FROM parts LEFT JOIN shares USING (citation), grid),
        w1 AS (SELECT *, source = 'laws_de' AND CASE mode WHEN 'df_only' THEN df >= 0.01 ELSE df >= 0.01 AND t / (c + t + x + 1e-9) >= 0.5 AND c / (c + t + x + 1e-9) <= 0.3 END AND t > 0 AS triggered FROM w0),
        weighed AS (SELECT * REPLACE (CASE WHEN triggered THEN t * greatest(0.0::DOUBLE, 1.0::DOUBLE - strength) ELSE t END AS t) FROM w1), {_recall('weighed')},
        trig AS (SELECT config_id, count(*) FILTER (WHERE triggered) AS n_triggered FROM weighed GROUP BY ALL) SELECT r.*, coalesce(n_triggered, 0) AS n_triggered FROM results r LEFT JOIN trig USING (config_id)""",
}
SQL["fp_profile"] = f"""WITH {S.GOLD}, {S.HITS}, {_FIELDS}, w AS (SELECT query_id, source, citation, c * 2.0::DOUBLE AS c, t * 2.0::DOUBLE AS t, x * 1.0::DOUBLE AS x FROM parts), s AS (SELECT *, round(greatest(c, t, x), 6) AS score FROM w),
    r AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation, source) AS INTEGER) AS rank FROM s) WHERE rank <= 200 AND source = 'laws_de'),
    lost AS (SELECT g.query_id, g.citation AS gold_citation, rank AS gold_rank, coalesce(c, 0.0) AS gc, coalesce(t, 0.0) AS gt, coalesce(x, 0.0) AS gx FROM gold g LEFT JOIN r ON r.query_id = g.query_id AND r.citation = g.citation WHERE rank IS NULL OR rank > 100),
    rivals AS (SELECT * FROM (SELECT * EXCLUDE (rank), CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation) AS INTEGER) AS fp_rank FROM r ANTI JOIN gold USING (query_id, citation)) WHERE fp_rank <= 20)
    SELECT v.query_id, gold_citation, v.citation AS fp_citation, fp_rank, coalesce(gold_rank, -1) AS gold_rank, CASE WHEN x > greatest(c, t) AND x > gx * 1.2::DOUBLE THEN 'text_over_power' WHEN t >= x AND t > gt * 1.2::DOUBLE THEN 'title_template_too_generic'
        WHEN gc < c * 0.7::DOUBLE THEN 'citation_signal_too_weak' WHEN x > gx OR t > gt OR c > gc THEN 'mixed_field_advantage' ELSE 'no_clear_component_gap' END AS why FROM rivals v JOIN lost USING (query_id)"""
SQL["routing_counts"] = (
    TEXT["route_counts"].rsplit("SELECT * FROM decided", 1)[0]
    + "SELECT route, count(*) AS n, round(avg(case_signals), 6) AS case_signals, count(*) FILTER (WHERE confidence = 'high') AS n_high FROM decided GROUP BY route"
)

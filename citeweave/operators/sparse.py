"""BM25: a stated query set is scored where the documents are read, or a stored index is searched."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType

from citeweave.functions import text as T
from citeweave.runtime import shuffle_partitions, spread

K1, B = 1.5, 0.75

#: Rows (query, term) and (group, term) that are handed to every task: some 100 MB. More queries take the stored way.
MOST_TERMS = 2_000_000

#: Tokens in a block of the stored index, about: what a task holds at once. A longer document is a block of its own.
BLOCK_TOKENS = 2_000_000


def counted(tokens: Column) -> Column:
    """(term, tf) of a document's tokens, counted within the row: equal words stand together once they are sorted."""

    def runs(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        return F.transform(F.array(starts), lambda at: F.transform(at, lambda b, j: F.struct(F.get(words, b).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(words)) - b).cast("long").alias("tf"))))[0]

    # Words and starts are bound once, as arguments of an outer lambda; as columns they would be inlined into the inner ones.
    counts = F.transform(F.array(F.array_sort(tokens)), runs)[0]
    return F.when(F.size(tokens) > 0, counts).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))


def postings(docs: DataFrame, text: Column, keys: list[str]) -> DataFrame:
    """B1: (keys, term, tf, dl) of every document; dl counts all its tokens. ``keys`` end with the document's id.

    All words of a document stand in its row, so nothing is shuffled.
    """
    rows = docs.select(*keys, T.tokens(text).alias("_t")).select(*keys, F.size("_t").alias("dl"), F.explode(counted(F.col("_t"))).alias("c"))
    return rows.select(*keys, "c.term", "dl", "c.tf")


def term_stats(docs: DataFrame, text: Column, group: list[str], vocabulary: DataFrame | None = None) -> DataFrame:
    """B2: n, avgdl, df and idf of every term of a group (or of ``vocabulary``, distinct terms), in one pass.

    Beside its distinct terms every document counts once for the empty term, whose row holds n and the mean length over
    all documents, those without a token included. Counts are combined on the map side.
    """
    rows = docs.select(*group, T.tokens(text).alias("_t")).select(*group, F.size("_t").alias("_dl"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("_t"))).alias("term"))
    if vocabulary is not None:
        wanted = vocabulary.select("term").unionByName(vocabulary.sparkSession.range(1).select(F.lit("").alias("term")))
        rows = rows.join(wanted, "term", "left_semi")
    return _with_idf(rows.groupBy(*group, "term").agg(F.count(F.lit(1)).alias("df"), F.avg("_dl").alias("avgdl")), group)


def _with_idf(counts: DataFrame, group: list[str]) -> DataFrame:
    """(group, term, df, avgdl) with a row for the empty term -> the terms with n, avgdl and idf."""
    whole = counts.where("term = ''").select(*group, F.col("df").alias("n"), "avgdl")
    out = counts.where("term <> ''").drop("avgdl").join(whole, group)
    return out.withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def query_terms(queries: DataFrame, query_id: str, text: Column) -> DataFrame:
    """(query_id, term, qtf): repeated words count as often as they stand."""
    return queries.select(query_id, F.explode(T.tokens(text)).alias("term")).groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25_scores(index: DataFrame, stats: DataFrame, terms: DataFrame, query_id: str, keys: list[str], group: list[str]) -> DataFrame:
    """B3 over postings, before the cut: score of every (query, document) that share a term, rounded to six places.

    The query side meets the term statistics first (a few rows a term), then the postings; partial sums are combined
    on the map side before the one shuffle by (query, document).
    """
    weighted = terms.join(stats, "term").select(query_id, *group, "term", (F.col("qtf") * F.col("idf")).alias("w"), "avgdl")
    hits = index.join(weighted, [*group, "term"])
    tf, length = F.col("tf"), F.col("dl") / (F.col("avgdl") + 1e-9)
    part = F.col("w") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length) + 1e-9)
    return hits.groupBy(query_id, *keys).agg(F.round(F.sum(part), 6).alias("score"))


def top_k(scores: DataFrame, partition: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Rows ranked within a partition, the first ``k`` kept; a literal cut, so that tasks cut before they shuffle."""
    return scores.withColumn(rank, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col(rank) <= k)


def bm25(docs: DataFrame, doc_text: Column, keys: list[str], group: list[str], queries: DataFrame, query_id: str, query_text: Column) -> DataFrame:
    """All scores from postings, without a cut; for query sets beyond MOST_TERMS and for small corpora."""
    terms = query_terms(queries, query_id, query_text)
    return bm25_scores(postings(docs, doc_text, keys), term_stats(docs, doc_text, group, terms.select("term").distinct()), terms, query_id, keys, group)


class _Wanted:
    """A query set with its statistics, as arrays: what every task needs to score its documents."""

    def __init__(self, terms: list, stats: list, boosts: dict) -> None:
        self.queries = sorted({r[0] for r in terms}, key=str)
        self.boost = np.array([boosts.get(q, 1.0) for q in self.queries], dtype=np.float64)
        place = {q: i for i, q in enumerate(self.queries)}
        self.terms = sorted({r[1] for r in terms})
        code = {t: i for i, t in enumerate(self.terms)}
        held = sorted((code[t], place[q], n) for q, t, n in terms)
        self.query = np.array([h[1] for h in held], dtype=np.int64)
        self.times = np.array([h[2] for h in held], dtype=np.float64)
        self.offsets = np.searchsorted(np.array([h[0] for h in held], dtype=np.int64), np.arange(len(self.terms) + 1))
        self.groups = {g: i for i, g in enumerate(sorted({r[0] for r in stats}))}
        self.avgdl = np.ones(max(1, len(self.groups)))
        self.idf = np.zeros((max(1, len(self.groups)), max(1, len(self.terms))))
        for g, t, idf, avgdl in stats:
            self.avgdl[self.groups[g]] = avgdl
            self.idf[self.groups[g], code[t]] = idf


def _six(x: np.ndarray) -> np.ndarray:
    """Rounded to six places, halves up, as SQL does."""
    return np.floor(x * 1e6 + 0.5) / 1e6


def _score(shared, n_group: int, n_keys: int, k: int, per_group: bool, arrow: pa.Schema, cells: int = 4_000_000):
    """Documents -> the ``k`` best of this task for every query (and group): one table is kept over all its batches."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: _Wanted = shared.value
        vocabulary, n_queries, n_groups = pa.array(wanted.terms, pa.string()), len(wanted.queries), max(1, len(wanted.groups))
        least = np.full(n_queries * (n_groups if per_group else 1), -np.inf)
        kept: tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table] | None = None

        def merge(slot: np.ndarray, query: np.ndarray, score: np.ndarray, rows: pa.Table) -> None:
            nonlocal kept
            if kept is not None:
                slot, query, score = (np.concatenate(p) for p in zip(kept[:3], (slot, query, score)))
                rows = pa.concat_tables([kept[3], rows])
            ties = [np.array(c.to_pylist()) for c in reversed(rows.columns[:n_keys])]
            order = np.lexsort((*ties, -score, slot))
            slots = slot[order]
            first = np.searchsorted(slots, slots)
            order = order[np.arange(len(order)) - first < k]
            kept = slot[order], query[order], score[order], rows.take(pa.array(order))
            full = np.bincount(kept[0], minlength=len(least)) >= k
            lowest = np.full(len(least), np.inf)
            np.minimum.at(lowest, kept[0], kept[2])
            least[full] = lowest[full]

        for batch in batches:
            if not n_queries or not wanted.groups:
                continue
            step = max(1, cells // n_queries)
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                n = part.num_rows
                lists = part.column(part.num_columns - 1)
                dl = np.asarray(pc.list_value_length(lists)).astype(np.int64)
                code = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1)).astype(np.int64)
                row = np.repeat(np.arange(n), dl)
                known = code >= 0
                pair, tf = np.unique(row[known] * len(wanted.terms) + code[known], return_counts=True)
                row, code = pair // len(wanted.terms), pair % len(wanted.terms)
                named = list(zip(*(part.column(i).to_pylist() for i in range(n_group))))
                group = np.array([wanted.groups.get(g, -1) for g in named], dtype=np.int64)
                length = dl[row] / (wanted.avgdl[group[row]] + 1e-9)
                worth = wanted.idf[group[row], code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length) + 1e-9)
                many = wanted.offsets[code + 1] - wanted.offsets[code]
                owner = np.repeat(np.arange(len(code)), many)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + wanted.offsets[code][owner]
                score = np.bincount(wanted.query[place] * n + row[owner], weights=worth[owner] * wanted.times[place], minlength=n_queries * n)
                query, doc = np.divmod(np.flatnonzero(score), n)
                score = _six(_six(score[score != 0]) * wanted.boost[query])
                slot = query * n_groups + group[doc] if per_group else query
                near = score >= least[slot]
                if near.any():
                    doc = doc[near]
                    rows = pa.Table.from_batches([part]).select(range(part.num_columns - 1)).take(pa.array(doc))
                    merge(slot[near], query[near], score[near], rows)
        if kept is not None:
            names = pa.array([wanted.queries[q] for q in kept[1].tolist()])
            columns = [names, *kept[3].columns, pa.array(kept[2])]
            for out in pa.table([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow).to_batches():
                yield out

    return op


def search(
    docs: DataFrame, text: Column, group: list[str], keys: list[str], queries: DataFrame, query_id: str, query_text: Column, k: int,
    per_group: bool = True, boost: str | None = None, carry: tuple[str, ...] = (),
) -> DataFrame:
    """The ``k`` best documents of every query (and of every ``group``, unless not ``per_group``), ranked: query_id,
    ``group``, ``keys``, ``carry``, score (six places, times the query's ``boost``), rank. Ties: ``group``, then ``keys``.

    1. One pass counts n, avgdl and df of the query terms, combined on the map side.
    2. Query terms and statistics (at most MOST_TERMS rows, checked) go to every task, which scores each document where it
       is read and keeps its k best for every query; only those are shuffled. No (document, term) and no (query, document)
       pairs are.

    More terms than that are joined with the postings instead. Cases: a document or query without a token is never found; a
    NULL text is empty; an empty table gives an empty result.
    """
    spark, docs = docs.sparkSession, spread(docs)
    terms = query_terms(queries, query_id, query_text)
    rows = terms.limit(MOST_TERMS + 1).collect()
    keys = [c for c in keys if c not in group]
    partition, order = ([query_id, *group] if per_group else [query_id]), [F.desc("score"), *[F.asc(c) for c in ([] if per_group else group) + keys]]
    weight = queries.select(query_id, (F.col(boost) if boost else F.lit(1.0)).cast("double").alias("_boost"))
    if len(rows) > MOST_TERMS:
        scores = bm25(docs, text, [*group, *keys, *carry], group, queries, query_id, query_text)
        scores = scores.join(weight, query_id).withColumn("score", F.round(F.col("score") * F.col("_boost"), 6)).drop("_boost")
        return top_k(scores, partition, order, k)
    vocabulary = spark.createDataFrame([(t,) for t in sorted({r["term"] for r in rows})], "term string")
    stats = term_stats(docs, text, group, vocabulary).select(F.struct(*group).alias("g"), "term", "idf", "avgdl").collect()
    boosts = {r[0]: r[1] for r in weight.collect()} if boost else {}
    shared = spark.sparkContext.broadcast(_Wanted([(r[query_id], r["term"], r["qtf"]) for r in rows], [(tuple(r.g), r.term, r.idf, r.avgdl) for r in stats], boosts))
    read = docs.select(*group, *keys, *carry, T.tokens(text).alias("_t"))
    kinds = {f.name: f.dataType for f in read.schema.fields} | {query_id: queries.schema[query_id].dataType}
    columns = [query_id, *group, *keys, *carry]
    arrow = pa.schema([*[pa.field(c, to_arrow_type(kinds[c])) for c in columns], pa.field("score", pa.float64())])
    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in columns) + ", score double"
    best = read.mapInArrow(_score(shared, len(group), len(group) + len(keys), k, per_group, arrow), schema)
    return top_k(best, partition, order, k)


def okapi(docs: DataFrame, text: Column, key: str, queries: DataFrame, query_id: str, query_text: Column, k: int, epsilon: float = 0.25) -> DataFrame:
    """The ``k`` best documents of every query over blank-separated words, with the classic idf ln((n - df + 0.5) /
    (df + 0.5)); a negative one counts as ``epsilon`` of the mean idf. Documents that share no word with a query are left out.
    """
    words = lambda c: F.filter(F.split(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"\s+"), lambda w: w != "")
    rows = docs.select(F.col(key), words(text).alias("_t")).withColumn("dl", F.size("_t"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = rows.select(F.explode(F.array_distinct("_t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.join(F.broadcast(whole)).select("term", "avgdl", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    terms = queries.select(query_id, F.explode(words(query_text)).alias("term")).groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("qtf"))
    mean = F.broadcast(raw.agg(F.avg("raw").alias("mean")))
    weighted = terms.join(raw, "term").join(mean).select(query_id, "term", "avgdl", (F.col("qtf") * F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw"))).alias("w"))
    index = rows.select(key, "dl", F.explode(counted(F.col("_t"))).alias("c")).select(key, "dl", "c.term", "c.tf")
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = index.join(weighted, "term").groupBy(query_id, key).agg(F.round(F.sum(part), 6).alias("score"))
    return top_k(scores, [query_id], [F.desc("score"), F.asc(key)], k)


# ---- stored index ---------------------------------------------------------------------------------------------------


def _index(n_group: int, n_keys: int, arrow: pa.Schema, tokens: int):
    """Documents (group, keys, tokens) -> blocks of the index, each of one group and sorted by term; documents of a block are
    numbered in the order of their keys."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_blocks, held, n_held = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.Table:
            nonlocal n_blocks
            rows = pa.Table.from_batches(held).combine_chunks()
            n, named = rows.num_rows, rows.column_names[: n_group + n_keys]
            order = pc.sort_indices(rows.select(named), sort_keys=[(c, "ascending") for c in named], null_placement="at_start")
            place = np.empty(n, dtype=np.int64)
            place[np.asarray(order)] = np.arange(n)
            listed = rows.column(n_group + n_keys).chunk(0)
            dl = np.asarray(pc.list_value_length(listed)).astype(np.int64)
            words = listed.flatten().dictionary_encode()
            sort = np.asarray(pc.sort_indices(words.dictionary))
            code = np.empty(len(sort), dtype=np.int64)
            code[sort] = np.arange(1, len(sort) + 1)
            rows = rows.select(named).take(order)
            owners = list(zip(*(rows.column(i).to_pylist() for i in range(n_group))))
            of = np.cumsum([0, *(a != b for a, b in pairwise(owners))])
            first = np.searchsorted(of, np.arange(of[-1] + 2))
            # A pair is (group, term, document); those of term 0, the empty one, hold the lengths of all documents.
            doc, n_terms = np.repeat(place, dl), len(sort) + 1
            pair, tf = np.unique((of[doc] * n_terms + code[np.asarray(words.indices)]) * n + doc, return_counts=True)
            pair, tf = np.concatenate([of * n_terms * n + np.arange(n), pair]), np.concatenate([dl[np.asarray(order)], tf])
            merged = np.argsort(pair, kind="stable")
            pair, tf = pair[merged], tf[merged]
            line, doc = np.divmod(pair, n)
            starts = np.flatnonzero(np.diff(line, prepend=-1))
            at, term = np.divmod(line[starts], n_terms)
            ends = np.append(starts, len(pair))
            lists = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)
            df = np.diff(ends)
            names = pa.concat_arrays([pa.array([""], pa.string()), words.dictionary.take(pa.array(sort)).cast(pa.string())])
            columns = [
                pa.array(n_blocks + at), *[c.take(pa.array(first[at])) for c in rows.columns[:n_group]], names.take(pa.array(term)), pa.array(df), pa.array(np.add.reduceat(tf, starts)),
                lists(df, pa.array((doc - first[of[doc]]).astype(np.int32))), lists(df, pa.array(tf.astype(np.int32))),
                *[lists(np.where(term == 0, df, 0), c.combine_chunks()) for c in rows.columns[n_group:]],
            ]
            n_blocks += int(of[-1]) + 1
            return pa.table([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            lengths = np.cumsum(np.asarray(pc.list_value_length(batch.column(n_group + n_keys))).astype(np.int64) + 1)
            cuts = [0, *(np.flatnonzero(np.diff(lengths // tokens)) + 1).tolist(), batch.num_rows]
            for a, b in pairwise(cuts):
                if a == b:
                    continue
                held.append(batch.slice(a, b - a))
                n_held += int(lengths[b - 1] - (lengths[a - 1] if a else 0))
                if n_held >= tokens:
                    yield from block().to_batches(max_chunksize=10_000)
                    held, n_held = [], 0
        if held:
            yield from block().to_batches(max_chunksize=10_000)

    return op


def _score_blocks(shared, n_group: int, k: int, arrow: pa.Schema):
    """Blocks of the index (block, group, term, doc, tf, keys), each in the order of its terms -> the ``k`` best of every block
    for every query, but for those that the task's earlier blocks leave no place among the ``k`` best."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: _Wanted = shared.value
        vocabulary, n_queries = pa.array(wanted.terms, pa.string()), len(wanted.queries)
        order = np.argsort(wanted.query, kind="stable")
        asked, times = np.repeat(np.arange(len(wanted.terms)), np.diff(wanted.offsets))[order], wanted.times[order]
        parts = np.searchsorted(wanted.query[order], np.arange(n_queries + 1)).tolist()
        best: dict[tuple[int, int], np.ndarray] = {}

        def scored(block: pa.Table) -> Iterator[pa.RecordBatch]:
            block = block.combine_chunks()
            group = tuple(c[0].as_py() for c in block.columns[1 : 1 + n_group])
            if group not in wanted.groups:
                return
            g = wanted.groups[group]
            terms, docs, tf, *keys = [c.chunk(0) for c in block.columns[1 + n_group :]]
            df = np.asarray(pc.list_value_length(docs)).astype(np.int64)
            code = np.asarray(pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1)).astype(np.int64)[1:]
            n, docs, tf = int(df[0]), np.asarray(docs.flatten()), np.asarray(tf.flatten())
            length, docs, tf, df = tf[:n] / (wanted.avgdl[g] + 1e-9), docs[n:], tf[n:], df[1:]
            worth = np.repeat(wanted.idf[g, code], df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[docs]) + 1e-9)
            begin, end = np.zeros(len(vocabulary), dtype=np.int64), np.zeros(len(vocabulary), dtype=np.int64)
            end[code] = np.cumsum(df)
            begin[code] = end[code] - df
            dense: dict[int, np.ndarray] = {}
            score, found = np.zeros(n), []
            for q in range(n_queries):
                here = slice(parts[q], parts[q + 1])
                codes = asked[here]
                spans = [x for x in zip(codes.tolist(), times[here].tolist(), begin[codes].tolist(), end[codes].tolist()) if x[2] < x[3]]
                if not spans:
                    continue
                score[:] = 0
                for c, w, a, b in spans:
                    if 4 * (b - a) < n:
                        score[docs[a:b]] += worth[a:b] * w
                        continue
                    if c not in dense:  # a term of many documents, as a row of all
                        dense[c] = np.zeros(n)
                        dense[c][docs[a:b]] = worth[a:b]
                    score += dense[c] if w == 1 else dense[c] * w
                known = best.get((q, g))
                least = known[0] if known is not None and len(known) == k else 0.0
                near = np.flatnonzero(score > max(0.0, least - 2e-6))  # before rounding
                points = score[near]
                if len(near) > k:
                    few = points >= np.partition(points, len(points) - k)[len(points) - k] - 2e-6
                    near, points = near[few], points[few]
                points = _six(points)
                first = np.lexsort((near, -points))[:k]
                near, points = near[first], points[first]
                near, points = near[points >= least], points[points >= least]
                if len(near):
                    best[q, g] = np.sort(points if known is None else np.concatenate([known, points]))[-k:]
                    found.append((q, near, points))
            if found:
                near = pa.array(np.concatenate([f[1] for f in found]))
                names = pa.array([wanted.queries[q] for q, at, _ in found for _ in range(len(at))])
                groups = [pa.array([v] * len(near), f.type) for v, f in zip(group, list(arrow)[1:])]
                columns = [names, *groups, *[c[0].values.take(near) for c in keys], pa.array(np.concatenate([f[2] for f in found]))]
                yield from pa.table([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow).to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            blocks = np.asarray(batch.column(0))
            for a, b in pairwise([0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]):
                if a == b:
                    continue
                if held and held[0].column(0)[0].as_py() != blocks[a]:
                    yield from scored(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from scored(pa.Table.from_batches(held))

    return op


def save_index(docs: DataFrame, text: Column, group: list[str], keys: list[str], folder: str, block_tokens: int = BLOCK_TOKENS) -> None:
    """Postings and statistics as parquet, for any number of searches.

    The documents are read once. Every task writes blocks of some ``block_tokens`` tokens; a row holds all postings of a term
    in a block of a group, and the row of the empty term the lengths and keys of all its documents. Rows of a block are sorted
    by term, so that pages without the terms of a search can be skipped. Postings are not shuffled, only the counts of a
    block's terms (and the documents, where ``spread`` has too few files).
    """
    spark, keys = docs.sparkSession, [c for c in keys if c not in group]
    read = spread(docs).select(*group, *keys, T.tokens(text).alias("_t"))
    kinds = {f.name: f.dataType for f in read.schema.fields}
    columns = {"_block": LongType()} | {c: kinds[c] for c in group} | {"term": StringType(), "_df": LongType(), "_total": LongType(), "_doc": ArrayType(IntegerType()), "_tf": ArrayType(IntegerType())} | {c: ArrayType(kinds[c]) for c in keys}
    arrow = pa.schema([pa.field(c, to_arrow_type(kind)) for c, kind in columns.items()])
    schema = ", ".join(f"`{c}` {kind.simpleString()}" for c, kind in columns.items())
    read.mapInArrow(_index(len(group), len(keys), arrow, block_tokens), schema).write.mode("overwrite").parquet(f"{folder}/postings")
    counts = spark.read.parquet(f"{folder}/postings").groupBy(*group, "term").agg(F.sum("_df").alias("df"), (F.sum("_total") / F.sum("_df")).alias("avgdl"))
    _with_idf(counts, group).write.mode("overwrite").parquet(f"{folder}/terms")


def stored_postings(index: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """The rows of ``postings`` from a stored index: (group, keys, term, dl, tf)."""
    docs = index.where("term = ''").select("_block", *group, F.posexplode(F.arrays_zip(*[F.col(c) for c in ("_tf", *keys)])).alias("_doc", "d"))
    docs = docs.select("_block", "_doc", *group, F.col("d._tf").alias("dl"), *[F.col(f"d.{c}").alias(c) for c in keys])
    hits = index.where("term <> ''").select("_block", "term", F.explode(F.arrays_zip("_doc", "_tf")).alias("h")).select("_block", "term", "h._doc", F.col("h._tf").alias("tf"))
    return hits.join(docs, ["_block", "_doc"]).select(*group, *keys, "term", "dl", "tf")


def search_index(spark: SparkSession, folder: str, group: list[str], keys: list[str], queries: DataFrame, query_id: str, query_text: Column, k: int) -> DataFrame:
    """The ``k`` best of every query and group from a stored index: query_id, ``group``, ``keys``, score, rank.

    Query terms and statistics (at most MOST_TERMS rows, checked) go to every task. The postings of these terms are brought
    together by block, and each block is scored for one query after the other; its k best are all that is shuffled again, no
    (query, document) pairs are. More terms than that are joined with the postings instead.
    """
    keys = [c for c in keys if c not in group]
    terms = query_terms(queries, query_id, query_text)
    index, stats = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/terms")
    rows = terms.limit(MOST_TERMS + 1).collect()
    partition, order = [query_id, *group], [F.desc("score"), *[F.asc(c) for c in keys]]
    if len(rows) > MOST_TERMS:
        named = terms.select("term").distinct().unionByName(spark.range(1).select(F.lit("").alias("term")))
        scores = bm25_scores(stored_postings(index.join(named, "term", "left_semi"), group, keys), stats, terms, query_id, [*group, *keys], group)
        return top_k(scores, partition, order, k)
    few = sorted({r["term"] for r in rows})
    if len(few) <= 1000:
        index, stats = index.where((F.col("term") == "") | F.col("term").isin(*few)), stats.where(F.col("term").isin(*few))
    else:
        named = spark.createDataFrame([(t,) for t in ["", *few]], "term string")
        index, stats = (t.join(F.broadcast(named), "term", "left_semi") for t in (index, stats))
    stats = stats.select(F.struct(*group).alias("g"), "term", "idf", "avgdl").collect()
    shared = spark.sparkContext.broadcast(_Wanted([(r[query_id], r["term"], r["qtf"]) for r in rows], [(tuple(r.g), r.term, r.idf, r.avgdl) for r in stats], {}))
    tasks = max(shuffle_partitions(spark), 2 * spark.sparkContext.defaultParallelism)
    blocks = index.select("_block", *group, "term", "_doc", "_tf", *keys).repartition(tasks, "_block").sortWithinPartitions("_block", "term")
    kinds = [queries.schema[query_id].dataType, *[index.schema[c].dataType for c in group], *[index.schema[c].dataType.elementType for c in keys], DoubleType()]
    columns = list(zip([query_id, *group, *keys, "score"], kinds))
    best = blocks.mapInArrow(_score_blocks(shared, len(group), k, pa.schema([pa.field(c, to_arrow_type(kind)) for c, kind in columns])), ", ".join(f"`{c}` {kind.simpleString()}" for c, kind in columns))
    return top_k(best, partition, order, k)

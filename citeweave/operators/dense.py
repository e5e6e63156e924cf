"""Exact inner-product search: corpus batches against blocks of queries, partial top-k in every task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators.sparse import top_k

SCHEMA = pa.schema([("query_id", pa.int64()), ("source", pa.string()), ("id", pa.int64()), ("score", pa.float64())])


def _search(ids: np.ndarray, matrix: np.ndarray, k: int, step: int = 1024):
    """Per task and source the ``k`` best of every query of the block, kept over all its batches; ties at the border all stay
    until the final rank."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of each source: the least score that still counts for every query, and the (query, row, score) kept so far.
        kept: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        least: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            sources = np.array(batch.column(0).to_pylist(), dtype=object)
            rows = np.asarray(batch.column(1))
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            vectors = flat.reshape(len(rows), -1)
            for source in dict.fromkeys(sources.tolist()):
                mine = np.flatnonzero(sources == source)
                bound = least.setdefault(source, np.full(len(ids), -np.inf))
                for a in range(0, len(mine), step):
                    part = mine[a : a + step]
                    scores = np.round(vectors[part] @ matrix.T, 9)
                    r, c = np.nonzero(scores >= bound - 1e-6)
                    if not len(r):
                        continue
                    query, row, score = c, rows[part][r], scores[r, c]
                    if source in kept:
                        query, row, score = (np.concatenate(p) for p in zip(kept[source], (query, row, score)))
                    order = np.lexsort((-score, query))
                    query, row, score = query[order], row[order], score[order]
                    place = np.arange(len(query)) - np.searchsorted(query, query)
                    edge = place == k - 1
                    bound[query[edge]] = score[edge]
                    keep = score >= bound[query] - 1e-6
                    kept[source] = query[keep], row[keep], score[keep]
        for source, (query, row, score) in kept.items():
            yield pa.record_batch([pa.array(ids[query]), pa.array([source] * len(query), pa.string()), pa.array(row), pa.array(score)], schema=SCHEMA)

    return op


def dense_scores(corpus: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(query_id, source, id, score) that can be among the ``k`` best of a query in a source.

    ``corpus``: id, source, embedding; ``queries``: query_id, embedding. Queries are a stated set; they are worked off in
    blocks of at most about ``block`` vectors, each small enough for every task. Rows without a vector take no part.
    """
    blocks = max(1, -(-queries.count() // block))
    out = None
    rows = corpus.where("embedding IS NOT NULL").select("source", F.col("id").cast("long").alias("id"), "embedding")
    for b in range(blocks):
        part = queries.where("embedding IS NOT NULL").where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").collect()
        if not part:
            continue
        ids, matrix = np.array([r.query_id for r in part], dtype=np.int64), np.array([r.embedding for r in part], dtype=np.float64)
        found = rows.mapInArrow(_search(ids, matrix, k), "query_id bigint, source string, id bigint, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = corpus.sparkSession.createDataFrame([], "query_id bigint, source string, id bigint, score double")
    return out.withColumn("score", F.round("score", 6))


def dense_top_k(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each source by (score, id), ranked over both sources: query_id, source, id, score, rank."""
    per_source = top_k(dense_scores(corpus, queries, k), ["query_id", "source"], [F.desc("score"), F.asc("id")], k, "source_rank")
    return top_k(per_source, ["query_id"], [F.desc("score"), F.asc("id")], 2 * k)


def dense_blocks(corpus: DataFrame, queries: DataFrame, k_laws: int, k_court: int) -> DataFrame:
    """The laws block before the court block; rank runs on."""
    per_source = top_k(dense_scores(corpus, queries, max(k_laws, k_court)), ["query_id", "source"], [F.desc("score"), F.asc("id")], max(k_laws, k_court), "source_rank")
    laws = F.col("source") == "laws_de"
    kept = per_source.where(F.when(laws, F.col("source_rank") <= k_laws).otherwise(F.col("source_rank") <= k_court))
    return top_k(kept, ["query_id"], [F.when(laws, 0).otherwise(1), F.asc("source_rank")], k_laws + k_court)


@lru_cache(maxsize=2)
def _signs(dims: int, bits: int, seed: int) -> np.ndarray:
    """A row of signs for each hashed gram, drawn once a worker: the top bits of a mixed (gram, place, seed)."""
    with np.errstate(over="ignore"):
        x = np.arange(1 << bits, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(dims, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.where(x >> np.uint64(63), np.int8(1), np.int8(-1))


def _project(grams: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The unit-length sum of one row of signs for each gram."""
    v = signs[grams.astype(np.int64)].sum(axis=0, dtype=np.int32).astype(np.float64)
    norm = np.linalg.norm(v)
    return v / norm if norm else v


#: An encoder turns a column of texts into a column of vectors; corpus and queries take the same one.
Encoder = Callable[[Column], Column]


def encode(rows: DataFrame, text: str, encoder: Encoder) -> DataFrame:
    """``rows`` with ``embedding``; the encoder may be a pandas UDF that hosts a model, or ``hashed_encoder``."""
    return rows.withColumn("embedding", encoder(F.col(text)))


def hashed_encoder(dims: int = 256, bits: int = 18, seed: int = 42) -> Encoder:
    """D3: hashed counts of words and word pairs, projected to ``dims`` by signs drawn from a hash, unit length.

    A Johnson-Lindenstrauss projection keeps inner products as well as a truncated decomposition and needs no pass over
    the corpus: each text becomes a vector where it is read. ``bits`` bound the hashed vocabulary.
    """

    def project(batches: pd.Series) -> pd.Series:
        signs = _signs(dims, bits, seed)
        sizes = np.array([len(words) for words in batches], dtype=np.int64)
        words = pd.util.hash_array(np.concatenate([np.asarray(w, dtype=object) for w in batches])) if sizes.sum() else np.zeros(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
        ends = np.cumsum(sizes)
        # The high bits; of the pairs of one text, all but the one with the next text's first word.
        keep = np.uint64(64 - bits)
        return pd.Series([_project(np.concatenate([words[b - n : b], pairs[b - n : max(b - 1, b - n)]]) >> keep, signs).tolist() for b, n in zip(ends, sizes)])

    project.__annotations__ = {"batches": pd.Series, "return": pd.Series}
    vectors = F.pandas_udf(project, "array<double>")

    def encoder(text: Column) -> Column:
        return vectors(T.tokens(text))

    return encoder


def hashed_vectors(rows: DataFrame, id_column: str, text, dims: int = 256, bits: int = 18, seed: int = 42) -> DataFrame:
    """D3: ``id_column`` and the hashed vector of ``text``."""
    return rows.select(F.col(id_column), hashed_encoder(dims, bits, seed)(text).alias("embedding"))

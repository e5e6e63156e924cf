"""Top N items within every group: bounded sorted runs, merged by a loser tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from citeweave.runtime import input_tasks


class LoserTree:
    """Tournament over the heads of sorted runs: ``pop`` gives the least head after log2(k) comparisons."""

    def __init__(self, runs: list) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.size = size = 1 << max(0, len(runs) - 1).bit_length()
        self.losers = [-1] * size
        winners = [-1] * size + [i if i < len(runs) else -1 for i in range(size)]
        for node in range(size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (b, a) if self._less(b, a) else (a, b)
        self.winner = winners[1] if size > 1 else winners[size]

    def _head(self, run: int):
        return self.runs[run][self.at[run]] if run >= 0 and self.at[run] < len(self.runs[run]) else None

    def _less(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return x is not None and (y is None or x < y)

    def pop(self):
        """The least element left, or None."""
        run = self.winner
        out = self._head(run)
        if out is None:
            return None
        self.at[run] += 1
        node = (self.size + run) >> 1
        while node:
            if self._less(self.losers[node], run):
                self.losers[node], run = run, self.losers[node]
            node >>= 1
        self.winner = run
        return out


def _first_of(table: pa.Table) -> np.ndarray:
    """Whether a row of a sorted table is the first of its item: group and all columns but the score."""
    key = np.zeros(table.num_rows, dtype=np.int64)
    for i in range(table.num_columns):
        if i != 1:
            code = np.asarray(pc.fill_null(pc.dictionary_encode(table.column(i), null_encoding="encode").combine_chunks().indices, 0)).astype(np.int64)
            # Numbered anew after each column, so that the pairs never overflow.
            key = np.unique(key * (int(code.max()) + 1) + code, return_inverse=True)[1]
    first = np.zeros(table.num_rows, dtype=bool)
    first[np.unique(key, return_index=True)[1]] = True
    return first


def _runs(n: int, key: str, arrow_key: pa.DataType, arrow_items: pa.StructType):
    """Cut a partition sorted by (group, order) into one run per group of at most ``n`` distinct items.

    The rest of a group is skipped by its run end, never looked at row by row; at most n rows are held over a batch
    border.
    """

    def emit(part: pa.Table) -> pa.RecordBatch:
        groups = part.column(0).combine_chunks()
        ends = np.asarray(pc.run_end_encode(groups).run_ends)
        starts = np.concatenate([[0], ends[:-1]])
        cols = [c.combine_chunks() for c in part.columns[1:]]
        items = pa.StructArray.from_arrays(cols, fields=list(arrow_items))
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        return pa.record_batch([groups.take(pa.array(starts)).cast(arrow_key), pa.ListArray.from_arrays(offsets, items)], names=[key, "run"])

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows or not n:
                continue
            rows = pa.Table.from_batches([batch])
            # The rows held are the first n distinct items of the open group; what follows of it ranks behind them.
            rows = rows if held is None else pa.concat_tables([held, rows])
            rows = rows.take(pa.array(np.flatnonzero(_first_of(rows))))
            ends = np.asarray(pc.run_end_encode(rows.column(0).combine_chunks()).run_ends)
            starts = np.concatenate([[0], ends[:-1]])
            keep = np.minimum(ends - starts, n)
            at = np.repeat(starts, keep) + (np.arange(keep.sum()) - np.repeat(np.cumsum(keep) - keep, keep))
            rows, done = rows.take(pa.array(at)), int(keep[:-1].sum())
            if done:
                yield emit(rows.slice(0, done))
            held = rows.slice(done).combine_chunks()
        if held is not None and held.num_rows:
            yield emit(held)

    return op


def _merge(n: int, fields: list[str], descending: list[bool], flat: pa.Schema | None, nested: pa.Schema):
    """Merge the runs of each group by a loser tree, seeking to the next group after ``n`` outputs. An item that several runs
    hold comes out once, at its best place."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            run_lists = lists.flatten()
            items = run_lists.flatten()
            columns = [items.field(i).to_pylist() for i in range(len(fields))]
            keys = list(zip(*[_sortable(c, d) for c, d in zip(columns, descending)]))
            run_ends = np.asarray(run_lists.offsets)
            run_ends = run_ends - run_ends[0]
            group_ends = np.asarray(lists.offsets)
            group_ends = group_ends - group_ends[0]
            take, ranks, owner, sizes = [], [], [], []
            for g in range(batch.num_rows):
                runs = [range(run_ends[r], run_ends[r + 1]) for r in range(group_ends[g], group_ends[g + 1])]
                tree = LoserTree([_View(keys, r) for r in runs])
                k, seen = 0, set()
                while k < n and (head := tree.pop()) is not None:
                    if len(runs) > 1:
                        if head[0][1:] in seen:
                            continue
                        seen.add(head[0][1:])
                    take.append(head[1])
                    k += 1
                    ranks.append(k)
                    owner.append(g)
                sizes.append(k)
            chosen = items.take(pa.array(take, type=pa.int64()))
            if flat is None:
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, chosen.cast(nested.field(1).type.value_type))], schema=nested)
            else:
                cols = [batch.column(0).take(pa.array(owner, type=pa.int64())), pa.array(ranks, type=pa.int32())]
                cols += [chosen.field(i) for i in range(len(fields))]
                yield pa.record_batch([c.cast(f.type) for c, f in zip(cols, flat)], schema=flat)

    return op


def _sortable(column: list, down: bool) -> list:
    """Values of one column as they sort: NULL last, descending where asked."""
    if None in column:
        return [(1, 0) if v is None else (0, -v if down else v) for v in column]
    return (-np.asarray(column)).tolist() if down else column


class _View:
    """A run as a sequence of (sort key, position) without copying."""

    def __init__(self, keys: list, span: range) -> None:
        self.keys, self.span = keys, span

    def __len__(self) -> int:
        return len(self.span)

    def __getitem__(self, i: int) -> tuple:
        at = self.span[i]
        return (self.keys[at], at)


def top_n_per_group(df: DataFrame, group: str, score: str, items: list[str], n: int, fan_in: int = 256) -> DataFrame:
    """The ``n`` best distinct items of every group: columns ``group``, ``item_rank`` (from 1), ``score``, ``*items``.

    An item is a distinct combination of ``items``; its score is the highest of its rows. Order: score descending, then
    ``items`` ascending by code point, NULLs last.

    1. Each task sorts the rows it reads by (group, order) and stores one run of at most n distinct items per group; the
       rest of a group is skipped. Nothing is shuffled before, and of a hot group a task passes on n items at most.
    2. Runs meet by group (at most one per task and n items each, so the largest group stays small), in a tree of
       ``fan_in`` where there are more tasks, and a loser tree merges them, each item once.

    Cases: rows whose score or first item column is NULL, or whose score is NaN, do not count; a NULL group is a group;
    a group without a counting row is absent; other columns of ``df`` are ignored, whatever their names; an empty table
    gives an empty result; n < 1 gives an empty result.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    value = F.col(score).cast("double")
    rows = df.select(F.col(group).alias("_g"), (value + F.lit(0.0)).alias("_s"), *[F.col(c).alias(f"_i{k}") for k, c in enumerate(items)])
    rows = rows.where(F.col("_s").isNotNull() & ~F.isnan("_s") & F.col("_i0").isNotNull())
    names = [f"_i{k}" for k in range(len(items))]
    best = rows.sortWithinPartitions("_g", F.desc("_s"), *[F.asc_nulls_last(c) for c in names])
    struct = T.StructType([T.StructField("_s", T.DoubleType()), *[T.StructField(c, kinds[i]) for c, i in zip(names, items)]])
    nested = T.StructType([T.StructField("_g", kinds[group]), T.StructField("run", T.ArrayType(struct))])
    flat = T.StructType([T.StructField(group, kinds[group]), T.StructField("item_rank", T.IntegerType()), T.StructField(score, T.DoubleType()), *[T.StructField(i, kinds[i]) for i in items]])
    arrow_struct = to_arrow_type(struct)
    runs = best.mapInArrow(_runs(max(0, n), "_g", to_arrow_type(kinds[group]), arrow_struct), nested)
    down = [True] + [False] * len(items)
    fields = ["_s", *names]
    arrow_nested = pa.schema([pa.field("_g", to_arrow_type(kinds[group])), pa.field("run", pa.list_(arrow_struct))])
    arrow_flat = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in flat.fields])
    tasks = input_tasks(rows)
    while tasks > fan_in:
        tasks = math.ceil(tasks / fan_in)
        gathered = runs.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(tasks))).groupBy("_g", "_part").agg(F.collect_list("run").alias("runs")).select("_g", "runs")
        runs = gathered.mapInArrow(_merge(n, fields, down, None, arrow_nested), nested)
    gathered = runs.groupBy("_g").agg(F.collect_list("run").alias("runs"))
    return gathered.mapInArrow(_merge(n, fields, down, arrow_flat, arrow_nested), flat)

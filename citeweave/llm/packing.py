"""Filling fixed-capacity containers: local best fit, nearly full containers leave, all the rest is mixed and packed again."""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.runtime import cut_lineage

#: Pre-token pattern of the byte-level BPE vocabulary (a fixed value of that public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SINGLE = re.compile(r"(?<=\S) (?=\S)")


class TokenCounter:
    """Exact token counts under a byte-level BPE, by way of the text between single blanks.

    No pre-token crosses from a character to a following single blank, so the counts of the stretches between such
    blanks add up; each distinct stretch is encoded once while it is remembered (``most`` of them).
    """

    def __init__(self, ranks_file: str, most: int = 500_000) -> None:
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.encode = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.most = most
        self.known = _Known(self.encode)

    def stretches(self, text: str) -> list[str]:
        return _SINGLE.split(text) if "  " in text else text.split(" ")

    def counts(self, parts: list[str]) -> list[int]:
        """Tokens of each stretch; all but the first count with the blank before them."""
        if len(self.known) > self.most:
            self.known.clear()
        return [len(self.encode(parts[0])), *map(self.known.__getitem__, parts[1:])]

    def count(self, text: str) -> int:
        return sum(self.counts(self.stretches(text))) if text else 0


class _Known(dict):
    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self.encode(" " + part))
        return n


def sized_pieces(counter: TokenCounter, text: str, capacity: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens): the whole text if it fits, else consecutive parts of at most ``capacity`` tokens."""
    parts = counter.stretches(text)
    counts = counter.counts(parts)
    if sum(counts) <= capacity:
        return [(0, len(text), sum(counts))]
    out: list[tuple[int, int, int]] = []
    start = at = used = 0
    for k, (part, n) in enumerate(zip(parts, counts)):
        end = at + len(part) + (k > 0)
        if used and used + n > capacity:
            out.append((start, at, used))
            start, used = at, 0
        if n > capacity:
            # Each character is at most four bytes and so at most four tokens.
            step = max(1, capacity // 4)
            for a in range(at, end, step):
                b = min(end, a + step)
                out.append((a, b, len(counter.encode(text[a:b]))))
            start, used = end, 0
        else:
            used += n
        at = end
    if used:
        out.append((start, at, used))
    return out


class BestFit:
    """Best-fit containers over integer sizes: the tightest open container by one bit scan."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.open, self.rooms = capacity, 0, {}
        self.bins: list[list[int]] = []
        self.room: list[int] = []

    def add(self, size: int, item: int) -> None:
        fits = self.open >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            stack = self.rooms[left]
            b = stack.pop()
            if not stack:
                self.open &= ~(1 << left)
            self.bins[b].append(item)
        else:
            left, b = self.capacity, len(self.bins)
            self.bins.append([item])
            self.room.append(0)
        left -= size
        self.room[b] = left
        self.rooms.setdefault(left, []).append(b)
        self.open |= 1 << left


ITEM = pa.struct([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("n_tokens", pa.int32())])
ROWS = pa.schema([("container_id", pa.int64()), ("done", pa.bool_()), ("used", pa.int32()), ("items", pa.list_(ITEM))])
SPARK_ROWS = "container_id bigint, done boolean, used int, items array<struct<doc_id: bigint, piece_no: int, start: int, end: int, n_tokens: int>>"


def _pack(sizes: list[int], groups: list[list[dict]], capacity: int, slack: int, level: int, last: bool, carry: int) -> pa.RecordBatch:
    """Best fit in decreasing order; what is nearly full is done, the items of every other container are handed on one by
    one, so that those of other tasks can fill up with them."""
    fit = BestFit(capacity)
    for i in np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable").tolist():
        fit.add(sizes[i], i)
    on = {b for b in range(len(fit.bins)) if fit.room[b] > slack} if not last else set()
    base = (level << 56) | (carry << 28)
    ids, done, used, items = [], [], [], []
    for b, members in enumerate(fit.bins):
        content = [x for i in members for x in groups[i]]
        if b in on:
            for x in content:
                ids.append(0), done.append(False), used.append(x["n_tokens"]), items.append([x])
        else:
            ids.append(base | b), done.append(True), used.append(capacity - fit.room[b]), items.append(content)
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(done, pa.bool_()), pa.array(used, pa.int32()), pa.array(items, ROWS.field("items").type)], schema=ROWS)


def pack_documents(
    df: DataFrame, doc_id: str, text: str, capacity: int, tokenizer_file: str, slack: int | None = None, fan_in: int = 16, keep: int | None = None, most: int = 100_000
) -> DataFrame:
    """Containers of at most ``capacity`` tokens: ``container_id``, ``doc_id``, ``piece_no``, ``start``, ``end``, ``n_tokens``.

    ``start`` and ``end`` are character offsets; a text that fits comes out whole (piece 0), one that alone exceeds the
    capacity in consecutive parts cut between words. Texts are read once and never shuffled: each task counts and packs
    what it reads and emits nearly full containers (at most ``slack`` tokens free). The items of all others, sizes and
    offsets without texts, are dealt out evenly over tasks of about ``most`` items, so that every task
    has the mix of sizes of the whole and complementary ones meet; a hot size is spread like any other. Rounds go on
    until one task holds what is left, or until a round fills up less than one in a hundred of its items: then the mix
    itself admits no fuller containers. (``fan_in`` and ``keep`` have no effect.)

    Cases: NULL and empty texts come out in no container; a text of blanks does; rows with the same id and text are
    packed each; a NULL id stays NULL; a stretch of more than ``capacity`` tokens without a blank is cut by characters;
    an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    slack = capacity // 128 if slack is None else slack
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, sizes, groups = TokenCounter(tokenizer_file), [], []
        for batch in batches:
            for doc, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for no, (a, b, n) in enumerate(sized_pieces(counter, whole, capacity)):
                    sizes.append(n)
                    groups.append([{"doc_id": doc, "piece_no": no, "start": a, "end": b, "n_tokens": n}])
        yield _pack(sizes, groups, capacity, slack, 0, False, TaskContext.get().partitionId())

    def again(level: int, last: bool):
        def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sizes, groups = [], []
            for batch in batches:
                sizes += batch.column(0).to_pylist()
                groups += batch.column(1).to_pylist()
            yield _pack(sizes, groups, capacity, slack, level, last, TaskContext.get().partitionId())

        return op

    packed = cut_lineage(rows.mapInArrow(first, SPARK_ROWS))
    finished, level, before = packed.where("done"), 0, None
    while left := packed.where("NOT done").count():
        level += 1
        tasks = math.ceil(left / most)
        last = tasks == 1 or (before is not None and left > 0.99 * before)
        packed, before = cut_lineage(packed.where("NOT done").select("used", "items").repartition(tasks).mapInArrow(again(level, last), SPARK_ROWS)), left
        finished = finished.unionByName(packed.where("done"))
    return finished.select("container_id", F.inline("items"))

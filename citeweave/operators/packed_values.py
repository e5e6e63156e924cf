"""Several values packed in one field: delimiter skeletons, one rule per distinct skeleton, positional extraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.operators.skew import join_unique
from citeweave.runtime import cut_lineage

SEPARATORS = ";；,|•\t\n\r"
#: Opening mark -> closing mark.
QUOTES = {'"': '"', "'": "'", "„": "“", "“": "”", "«": "»", "‹": "›"}
CLOSING = frozenset(QUOTES.values())
MARKS = SEPARATORS + "/[]\\﻿" + "".join(dict.fromkeys("".join(QUOTES) + "".join(QUOTES.values())))
#: Unicode white space without the separators; "s" in a skeleton.
SPACES = " \u000b\u000c\u0085   -     　"

_CLASS = "".join("\\" + c if c in '\\[]^-"' else c for c in MARKS)
#: From one ordinary character to the last before a mark; without a repeated group, which Java's engine would recurse into.
WORD = f"[^{_CLASS}{SPACES}](?:[^{_CLASS}]*[^{_CLASS}{SPACES}])?"
SPACE = f"[{SPACES}]+"
TOKEN = f"{WORD}|{SPACE}|[{_CLASS}]"

RULE = T.ArrayType(T.ArrayType(T.IntegerType()))


def skeleton(field: Column) -> Column:
    """``field`` with every run of ordinary words as ``x`` and every run of blanks as ``s``; marks stay."""
    return F.regexp_replace(F.regexp_replace(field, WORD, "x"), SPACE, "s")


def resolve(skel: str) -> list[list[int]]:
    """The values of a skeleton, each as the positions of its tokens, left to right.

    A value that opens with a quote mark runs to its closing mark followed by a separator or the end; marks inside do
    not separate, a doubled or backslashed mark counts once. Elsewhere each separator ends a value, a slash only
    between blanks. List brackets around the whole field and byte order marks are dropped. A quote that never closes
    is an ordinary character.
    """
    at, end = 0, len(skel)
    while at < end and skel[at] in "s﻿\t\n\r":
        at += 1
    while end > at and skel[end - 1] in "s﻿\t\n\r":
        end -= 1
    if end - at >= 2 and skel[at] == "[" and skel[end - 1] == "]":
        at, end = at + 1, end - 1
    values: list[list[int]] = []
    current: list[int] = []

    def close(value: list[int]) -> None:
        a, b = 0, len(value)
        while a < b and skel[value[a]] in "s﻿\t\n\r":
            a += 1
        while b > a and skel[value[b - 1]] in "s﻿\t\n\r":
            b -= 1
        if a < b:
            values.append(value[a:b])

    def separates(i: int) -> bool:
        return skel[i] in SEPARATORS or skel[i] == "/" and i > 0 and skel[i - 1] == "s" and i + 1 < len(skel) and skel[i + 1] == "s"

    # Where a mark of each kind could close a value last; no quote that opens behind it is looked through in vain.
    latest: dict[str, int] = {}
    ends = True
    for i in range(end - 1, at - 1, -1):
        if ends and skel[i] in CLOSING:
            latest.setdefault(skel[i], i)
        ends = separates(i) or ends and skel[i] in "s﻿"

    i = at
    while i < end:
        mark = skel[i]
        if mark in QUOTES and latest.get(QUOTES[mark], -1) > i and all(skel[k] in "s﻿" for k in current):
            shut, inner, j = QUOTES[mark], [], i + 1
            done = -1
            while j < end:
                if skel[j] == "\\" and j + 1 < end:
                    inner.append(j + 1)
                    j += 2
                    continue
                if skel[j] == shut:
                    if shut == mark and j + 1 < end and skel[j + 1] == shut:
                        inner.append(j)
                        j += 2
                        continue
                    k = j + 1
                    while k < end and skel[k] in "s﻿":
                        k += 1
                    if k >= end or separates(k):
                        done = k
                        break
                inner.append(j)
                j += 1
            if done >= 0:
                close(inner)
                current, i = [], done + 1
                continue
        if separates(i):
            close(current)
            current = []
        else:
            current.append(i)
        i += 1
    close(current)
    return values


@F.pandas_udf(RULE)
def _resolve_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for skeletons in batches:
        yield skeletons.map(resolve)


def split_packed(df: DataFrame, field: str, keys: list[str], value: str = "value", pos: str = "pos") -> DataFrame:
    """One row per value of ``field``: ``keys``, ``pos`` (from 0, INT), ``value``.

    Fields without any mark hold one value and need no rule. The others share few skeletons: each distinct one is
    resolved once. Rules of hot skeletons (at most MAX_HOT by construction) are broadcast; the rest meet their rows by
    an ordinary join on the skeleton's hash, which the planner broadcasts only below its checked size. Values are then
    cut out by token position inside the JVM.

    Cases: a NULL, empty or blank field, or one of marks only, gives no row; repeated values and repeated rows stay;
    values keep everything inside them, blanks included; other columns are ignored, whatever their names.
    """
    rows = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(field).cast("string").alias("_f"))
    rows = rows.where(F.col("_f").isNotNull() & (F.trim(F.col("_f")) != ""))
    plain = rows.where(~F.col("_f").rlike(f"[{_CLASS}]"))
    plain = plain.select(*[f"_k{i}" for i in range(len(keys))], F.array(F.regexp_replace("_f", f"^[{SPACES}]+|[{SPACES}]+$", "")).alias("_v"))
    marked = cut_lineage(rows.where(F.col("_f").rlike(f"[{_CLASS}]")).withColumn("_h", F.unhex(F.md5(skeleton(F.col("_f"))))))
    seen = marked.groupBy("_h").agg(F.any_value("_f").alias("_one"))
    rules = cut_lineage(seen.select("_h", _resolve_all(skeleton(F.col("_one"))).alias("_r")))
    ruled = join_unique(marked, rules, "_h")
    # The tokens are bound once, as the argument of an outer lambda: as a column they would be inlined into the inner
    # one and the whole field matched again for every token.
    tokens = F.array(F.regexp_extract_all("_f", F.lit(TOKEN), 0))
    values = F.transform(tokens, lambda t: F.transform("_r", lambda v: F.array_join(F.transform(v, lambda i: F.element_at(t, i + 1)), "")))[0]
    ruled = ruled.select(*[f"_k{i}" for i in range(len(keys))], values.alias("_v"))
    out = plain.unionByName(ruled).select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.posexplode_outer("_v").alias(pos, value))
    return out.where(F.col(value) != "")

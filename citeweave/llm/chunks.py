"""Splitting oversized texts at natural boundaries: a recursive hierarchy of separators, packed greedily with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode White_Space.
SPACE = r"[\t-\r \x85\xa0  -     　]"
SOLID = r"[^\t-\r \x85\xa0  -     　]"
#: Where each level ends an atom: after a blank line, after a line, after a sentence (the mark follows a word of four
#: letters or more, so abbreviations do not count), after a clause.
LEVELS = [
    ("section", re.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:(?:\r\n?|\n)[^\S\r\n]*)+")),
    ("paragraph", re.compile(r"\r\n?|\n| | ")),
    ("sentence", re.compile(r"(?<=[^\W\d_]{4}[.!?…])[\"'»“”)\]]*" + SPACE + r"+(?=[^\w\s]*[A-ZÀ-ÞĀ-Ž0-9])|[。！？]")),
    ("clause", re.compile(r"(?<=[;:,])" + SPACE + "+")),
]
WORD = re.compile(f"{SPACE}+|{SOLID}+")


def atoms(text: str, start: int, end: int, level: int, room: int, limit: int, kind: str) -> Iterator[tuple[int, int, str]]:
    """Spans of text[start:end] of at most ``room`` characters, each with the boundary it ends at.

    An unbroken run of at most ``limit`` characters stays whole; a longer one is cut by characters (``hard``).
    """
    if end - start <= room:
        yield start, end, kind
        return
    if level < len(LEVELS):
        name, separator = LEVELS[level]
        at = start
        for m in separator.finditer(text, start, end):
            if m.end() < end:
                yield from atoms(text, at, m.end(), level + 1, room, limit, name)
                at = m.end()
        yield from atoms(text, at, end, level + 1, room, limit, kind)
        return
    for m in WORD.finditer(text, start, end):
        a, b = m.span()
        blank = text[a].isspace()
        if b - a <= (room if blank else limit):
            yield a, b, kind if b == end else "word"
            continue
        for x in range(a, b, room):
            y = min(b, x + room)
            yield x, y, kind if y == end else "word" if blank or y == b else "hard"


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """Pieces (start, fresh, end, boundary): the piece is text[start:end], text[start:fresh] repeats the piece before.

    Fresh parts join to the whole text. The repeated part is at most ``overlap`` characters, shorter to begin at a word
    or to leave room for an unbroken run.
    """
    room = max(1, limit - overlap)
    pieces: list[tuple[int, int, int, str]] = []
    start = fresh = stop = 0
    bound = ""
    for a, b, kind in atoms(text, 0, len(text), 0, room, limit, "end"):
        if stop > fresh and b - start > limit:
            pieces.append((start, fresh, stop, bound))
            fresh = stop
            earliest = max(start, fresh - overlap, b - limit, 0)
            start = earliest
            if earliest > 0 and not text[earliest - 1].isspace():
                for m in WORD.finditer(text, earliest, fresh):
                    if m.start() > earliest and not text[m.start()].isspace():
                        start = m.start()
                        break
        stop, bound = b, kind
    if stop > fresh:
        pieces.append((start, fresh, stop, bound))
    return pieces


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: int, overlap: int) -> DataFrame:
    """Pieces of every text of more than ``limit`` characters (Unicode code points).

    Columns: ``keys``, ``piece_no`` (from 0), ``start`` and ``end`` (offsets in the text), ``overlap`` (characters
    repeated from the piece before), ``boundary`` (section, paragraph, sentence, clause, word, hard or end), ``piece``,
    ``row_hard`` (some cut of the text was hard). No shuffle: each text is cut where it is read, shorter texts never
    leave the JVM.

    Cases: NULL, empty and short texts give no row; very long texts are cut whole; repeated rows give repeated pieces;
    an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).alias("_text")).where(F.length("_text") > limit)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for *key, whole in batch.itertuples(index=False, name=None):
                pieces = cut(whole, limit, overlap)
                hard = any(bound == "hard" for *_, bound in pieces)
                out += [(*key, no, a, b, fresh - a, bound, whole[a:b], hard) for no, (a, fresh, b, bound) in enumerate(pieces)]
            yield pd.DataFrame(out, columns=columns)

    columns = [*names, "piece_no", "start", "end", "overlap", "boundary", "piece", "row_hard"]
    schema = ", ".join([*[f"{n} {kinds[n]}" for n in names], "piece_no int, start int, `end` int, overlap int, boundary string, piece string, row_hard boolean"])
    return rows.mapInPandas(op, schema).withColumnsRenamed(dict(zip(names, keys)))

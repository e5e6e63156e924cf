"""Evaluation texts leaking into training text: rare n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.runtime import cut_lineage, scratch, spread

_WORDS = re.compile(r"\w+|\x00")
#: Spellings of one letter that are told apart in no language here.
FOLDS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("é", "e"), ("è", "e"), ("ê", "e"), ("à", "a"), ("â", "a"), ("ç", "c"), ("ô", "o"), ("î", "i"), ("ò", "o"), ("ù", "u"))


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        for a, b in FOLDS:
            text = text.replace(a, b)
    return text


class _Known(dict):
    """Words as codes of one item, remembered; -1 is a word that may be a piece of a word or two words run together."""

    def __init__(self, items: Items, k: int) -> None:
        super().__init__()
        self.exact, self.shorter, self.joined = items.near(k)
        self.alike = items.alike
        self.starts = {w[:i] for w in self.exact for i in range(1, len(w))}

    def spelt(self, w: str) -> int:
        return next((self.shorter[v][0] for v in self.alike(w) if v in self.shorter), 0)

    def __missing__(self, w: str) -> int:
        code = self.exact.get(w, 0) or (-1 if w in self.starts or w in self.joined else self.spelt(w))
        self[w] = code
        return code


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A key for every ``n`` codes in a row; keys may collide, which costs a look and decides nothing."""
    key = np.zeros(max(0, len(codes) - n + 1), dtype=np.int64)
    with np.errstate(over="ignore"):
        for j in range(n):
            key = key * np.int64(6364136223846793005) + codes[j : j + len(key)]
    return key


class _Numbers(dict):
    """Words of documents as numbers: 0 for a word that no item has or resembles, -1 for the border of two documents."""

    def __init__(self, items: Items) -> None:
        super().__init__({"\x00": -1})
        self.items = items
        self.words, self.codes, self.related, self.head, self.tail = [""], [0], [[]], [False], [False]

    def __missing__(self, w: str) -> int:
        items = self.items
        related, head, tail = items.related(w), w in items.heads, w in items.tails
        number = 0
        if related or head or tail:
            number = len(self.words)
            for column, value in zip((self.words, self.codes, self.related, self.head, self.tail), (w, items.vocabulary.get(w, 0), related, head, tail)):
                column.append(value)
        self[w] = number
        return number


def deletions(w: str) -> list[str]:
    return [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))]


class Items:
    """Evaluation items as word codes, their n-grams, and each item's words with their near spellings.

    Items of the same words are one class, held under the place of the first; ``ids`` has all ids of a class.
    """

    def __init__(self, items: list[tuple[int, str]], n: int) -> None:
        classes: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for i, t in items:
            classes[tuple(_WORDS.findall(fold(t.replace("\x00", " "))))].append(i)
        self.n = n
        self.ids = list(classes.values())
        self.words = [list(ws) for ws in classes]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for ws in self.words for w in ws}), 1)}
        coded = [np.array([self.vocabulary[w] for w in ws], dtype=np.int64) for ws in self.words]
        self.lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        flat = np.concatenate(coded) if coded else np.zeros(0, dtype=np.int64)
        keys, held, places = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for k, codes in enumerate(coded):
            if len(codes) >= n:
                key = grams(codes, n)
                keys.append(key)
                held.append(np.full(len(key), k, dtype=np.int64))
                places.append(np.arange(len(key), dtype=np.int64))
        key, item, place = np.concatenate(keys), np.concatenate(held), np.concatenate(places)
        order = np.lexsort((place, item, key))
        self.keys, first = np.unique(key[order], return_index=True)
        self.offsets = np.append(first, len(key)).astype(np.int64)
        self.item_of, self.at_of = item[order], place[order]
        # Each item's distinct words as sorted keys (item, code), and for every word of every item the place of its key.
        self.base = len(self.vocabulary) + 1
        pairs = np.repeat(np.arange(len(coded), dtype=np.int64), self.lengths) * self.base + flat
        self.members, self.member_of = np.unique(pairs, return_inverse=True)
        self.member_starts = np.searchsorted(self.members, np.arange(len(coded) + 1, dtype=np.int64) * self.base)
        self._near: dict[int, tuple[dict, dict, dict]] = {}
        self.shorter: dict[str, list[int]] = defaultdict(list)
        for w, c in self.vocabulary.items():
            if len(w) > 3 and not w.isdigit():
                for v in set(deletions(w)):
                    self.shorter[v].append(c)
        self.joined: dict[str, set[int]] = defaultdict(set)
        for ws in self.words:
            for x, y in zip(ws, ws[1:]):
                self.joined[x + y] |= {self.vocabulary[x], self.vocabulary[y]}
        self.heads = {w[:i] for w in self.vocabulary for i in range(1, len(w))}
        self.tails = {w[i:] for w in self.vocabulary for i in range(1, len(w))}
        self._alike: dict[str, list[str]] = {}
        self._known: dict[int, _Known] = {}

    def related(self, w: str) -> list[int]:
        """Every code that the word may stand for in some item: itself, near spellings, two words run together."""
        codes = {self.vocabulary[w]} if w in self.vocabulary else set()
        for v in self.alike(w):
            codes.update(self.shorter[v])
        return sorted(codes | self.joined.get(w, set()))

    def alike(self, w: str) -> list[str]:
        """The word and its deletions, as far as any item's words have them."""
        if w not in self._alike:
            if len(self._alike) > 200_000:
                self._alike.clear()
            self._alike[w] = [v for v in deletions(w) if v in self.shorter] if len(w) > 3 and not w.isdigit() else []
        return self._alike[w]

    def near(self, k: int) -> tuple[dict[str, int], dict[str, list[int]], dict[str, tuple[int, int]]]:
        """Of item k: word -> code, deletion -> codes, two adjacent words run together -> their codes."""
        if k not in self._near:
            exact: dict[str, int] = {}
            for w in self.words[k]:
                exact.setdefault(w, len(exact) + 1)
            shorter: dict[str, list[int]] = defaultdict(list)
            for w, c in exact.items():
                if len(w) > 3 and not w.isdigit():
                    for v in set(deletions(w)):
                        shorter[v].append(c)
            joined = {a + b: (exact[a], exact[b]) for a, b in zip(self.words[k], self.words[k][1:])}
            self._near[k] = exact, shorter, joined
        return self._near[k]

    def known(self, k: int) -> _Known:
        if k not in self._known:
            self._known[k] = _Known(self, k)
        elif len(self._known[k]) > max(500, 1_000_000 // len(self.ids)):
            self._known[k].clear()
        return self._known[k]

    def codes(self, k: int, words: list[str], part: bool = True) -> tuple[list[int], Sequence[int]]:
        """A passage's words as codes of item k, and the place of each; 0 is a word the item does not have.

        One letter too many, too few, changed or swapped with its neighbour is forgiven; a word broken in two is
        mended, two run together are parted (unless not ``part``: "zudem" may also be put in beside "zu dem").
        """
        exact, _, joined = self.near(k)
        known = self.known(k)
        alone = list(map(known.__getitem__, words))
        if -1 not in alone:
            return alone, range(len(words))
        out, places, i = [], [], 0
        while i < len(words):
            w, code = words[i], alone[i]
            if code < 0:
                if i + 1 < len(words) and (pair := exact.get(w + words[i + 1], 0)):
                    out.append(pair)
                    places.append(i)
                    i += 2
                    continue
                if part and w in joined:
                    out += joined[w]
                    places += [i, i]
                    i += 1
                    continue
                code = known.spelt(w)
            out.append(code)
            places.append(i)
            i += 1
        return out, places


_ONE, _MASK = 1 << 20, (1 << 20) - 1


def align(pairs: list[tuple[list[int], list[int]]]) -> list[tuple[int, int, int]]:
    """Smith-Waterman over words for many (item, passage) pairs at once: (score, first, last) of the best local alignment.

    Match 1, mismatch -1, gap -1. A cell holds the score and, below it, where in the item its alignment began, so the
    span comes out without a trace back. Rows run over the item; gaps along a row by a running maximum.
    """
    n, m = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    item = np.full((len(pairs), n), -1, dtype=np.int32)
    passage = np.zeros((len(pairs), m), dtype=np.int32)
    for k, (a, b) in enumerate(pairs):
        item[k, : len(a)], passage[k, : len(b)] = a, b
    ramp = np.arange(m, dtype=np.int64) * _ONE
    cells = np.full((len(pairs), m + 1), _MASK, dtype=np.int64)
    best = np.zeros(len(pairs), dtype=np.int64)
    last = np.zeros(len(pairs), dtype=np.int64)
    for i in range(n):
        step = np.where(passage == item[:, i : i + 1], _ONE, -_ONE)
        fresh = _MASK - i
        before = np.where(cells[:, :-1] < _ONE, fresh, cells[:, :-1])
        here = np.maximum(before + step, cells[:, 1:] - _ONE)
        here = np.maximum.accumulate(here + ramp, axis=1) - ramp
        cells[:, 1:] = np.where(here < _ONE, _MASK - i - 1, here)
        cells[:, 0] = _MASK - i - 1
        top = here.max(axis=1)
        better = (top >> 20) > (best >> 20)
        best, last = np.where(better, top, best), np.where(better, i, last)
    return [(int(b >> 20), int(_MASK - (b & _MASK)), int(e)) for b, e in zip(best, last)]


#: Of a cell: its score in units of _UNIT, and below it the item words covered, which decide between equal scores.
_UNIT = 1 << 15
_NONE = -(1 << 28)
_BROKEN = re.compile(rb"\x00(?=\x00|\x01\x00)")


def claims(pairs: list[tuple[list[int], list[int]]], span: int, share: float) -> list[tuple[int, list[int]] | None]:
    """Of many (item, passage) pairs at once: (score, places of the passage that match) of the best stretch of ``span`` item
    words or more in which every edit stands alone, or None.

    Match 1, a word replaced, left out or put in -1; two matches or more stand between edits. So a stretch never bridges
    edits side by side, and needs no telling words: wording that items share ends where their own words differ.
    """
    n, m = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    item = np.full((len(pairs), n), -1, dtype=np.int32)
    passage = np.zeros((len(pairs), m), dtype=np.int32)
    for k, (a, b) in enumerate(pairs):
        item[k, : len(a)], passage[k, : len(b)] = a, b
    # Of each cell: an alignment that ends in a match right behind an edit, in another match, or in an edit.
    single, match, edit = (np.full((n + 1, len(pairs), m + 1), _NONE, dtype=np.int32) for _ in range(3))
    for i in range(1, n + 1):
        same = passage == item[:, i - 1 : i]
        single[i, :, 1:] = np.where(same, edit[i - 1, :, :-1] + (_UNIT + 1), _NONE)
        before = np.maximum(np.maximum(single[i - 1, :, :-1], match[i - 1, :, :-1]), 0)
        match[i, :, 1:] = np.where(same, before + (_UNIT + 1), _NONE)
        edit[i] = match[i - 1] - (_UNIT - 1)
        edit[i, :, 1:] = np.maximum(edit[i, :, 1:], np.maximum(match[i - 1, :, :-1] - (_UNIT - 1), match[i, :, :-1] - _UNIT))
    ends = np.maximum(single, match)
    ends = np.where((ends > 0) & (ends & (_UNIT - 1) >= span), ends, _NONE).transpose(1, 0, 2).reshape(len(pairs), -1)
    out: list[tuple[int, list[int]] | None] = []
    for k, at in enumerate(ends.argmax(axis=1).tolist()):
        best = int(ends[k, at])
        score, covered = best // _UNIT, best & (_UNIT - 1)
        if best <= 0 or score < covered * share:
            out.append(None)
            continue
        i, j = divmod(at, m + 1)
        value, places = best, []
        while True:
            places.append(j - 1)
            behind_edit = single[i, k, j] == value
            i, j, value = i - 1, j - 1, value - (_UNIT + 1)
            if behind_edit:
                if match[i - 1, k, j - 1] - (_UNIT - 1) == value:
                    i, j, value = i - 1, j - 1, value + (_UNIT - 1)
                elif match[i - 1, k, j] - (_UNIT - 1) == value:
                    i, value = i - 1, value + (_UNIT - 1)
                else:
                    j, value = j - 1, value + _UNIT
            elif value <= 0:
                break
        out.append((score, places[::-1]))
    return out


def promising(seen: list[int], span: int) -> bool:
    """Whether a passage can hold a stretch at all: words the item lacks are edits, and between edits stand two matches,
    so ``span`` words take two matches in three without two lacking words beside each other or around one word. (A
    stretch's ends may lose a word to the cuts, hence the two less.)"""
    least = -(-2 * span // 3) - 2
    return any(part.count(1) >= least for part in _BROKEN.split(bytes(map(bool, seen))))


CLAIMS = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("item_id", pa.int64()), ("places", pa.list_(pa.int32()))])
SPARK_CLAIMS = "doc_id bigint, copy bigint, item_id bigint, places array<int>"
PAIRS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches of an array: the number of the stretch, and the place, of each of their elements."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]


def _hopeful(items: Items, numbers: _Numbers, ids: np.ndarray, pieces: np.ndarray, item: np.ndarray, first: np.ndarray, final: np.ndarray, span: int) -> np.ndarray:
    """Which passages may hold a stretch of their item: ``span`` item words in a row of which those that the passage lacks, in
    any spelling, stand three words apart, as edits do. Sets of words only, so what is left out cannot hold one."""
    sizes = np.array([len(r) for r in numbers.related], dtype=np.int64)
    offsets = np.cumsum(sizes) - sizes
    codes = np.array([c for r in numbers.related for c in r], dtype=np.int64)
    owner, at = _spread(first, final - first)
    word = np.maximum(ids[at], 0)
    inner, place = _spread(offsets[word], sizes[word])
    owners, found = [owner[inner]], [codes[place]]
    split = np.flatnonzero((pieces[at] > 0) & (at + 1 < final[owner]))
    owners.append(owner[split])
    found.append(pieces[at[split]])
    owner, code = np.concatenate(owners), np.concatenate(found)
    key = item[owner] * items.base + code
    member = np.minimum(np.searchsorted(items.members, key), len(items.members) - 1)
    hit = items.members[member] == key
    many = items.member_starts[item + 1] - items.member_starts[item]
    begin = np.cumsum(many) - many
    present = np.zeros(int(many.sum()), dtype=bool)
    owner, member = owner[hit], member[hit]
    present[begin[owner] + member - items.member_starts[item[owner]]] = True
    lengths = items.lengths[item]
    owner, at = _spread(items.starts[item], lengths)
    absent = np.flatnonzero(~present[begin[owner] + items.member_of[at] - items.member_starts[item[owner]]])
    # Where the stretch that ends at a word begins at the latest: behind the earlier of two lacking words that stand too near.
    reset = np.repeat(np.cumsum(lengths) - lengths, lengths)
    near = (np.diff(absent) < 3) & (owner[absent[1:]] == owner[absent[:-1]])
    since = reset.copy()
    since[absent[1:][near]] = absent[:-1][near] + 1
    long = np.arange(len(owner)) - np.maximum.accumulate(since) + 1 >= span
    return np.logical_or.reduceat(long, np.cumsum(lengths) - lengths)


def winners(claimed: list[tuple[int, list[int]]]) -> list[int]:
    """Of one document's claims (item, places of the matching words): the items that no other beats. An item is beaten by
    one that matches more words within its stretch. Only claims that overlap are compared, and equal places once."""
    holders: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for item, places in claimed:
        holders[tuple(places)].append(item)
    stretches = sorted(holders)
    most = max((p[-1] - p[0] for p in stretches), default=0)
    kept: list[int] = []
    for at, mine in enumerate(stretches):
        low, high = mine[0], mine[-1]
        near = range(bisect_left(stretches, (low - most,)), bisect_left(stretches, (high + 1,)))
        if not any(bisect_left(stretches[b], high + 1) - bisect_left(stretches[b], low) > len(mine) for b in near if b != at and stretches[b][-1] >= low):
            kept += holders[mine]
    return kept


def _search(shared, drift: int, reach: int, least: int, span: int, share: float, final_pairs: bool, many_at_once: int = 128, most_words: int = 4_000_000):
    """Documents -> the items they hold (or, if not ``final_pairs``, the claims with the places of the matching words).

    A passage is looked at where ``least`` seeds of one item lie on nearly one diagonal, however common they are, and aligned
    if its words can make up a stretch.
    """

    def passages(items: Items, numbers: _Numbers, ids: np.ndarray, borders: np.ndarray):
        """(document, item, first word of the document, first and last word of the passage) of every passage worth aligning."""
        n, none = items.n, [np.zeros(0, dtype=np.int64)] * 5
        codes = np.array(numbers.codes, dtype=np.int64)[np.maximum(ids, 0)]
        if len(codes) < n or not len(items.keys):
            return none
        whole = np.ones(len(codes) - n + 1, dtype=bool)
        for j in range(n):
            whole &= codes[j : j + len(whole)] > 0
        at = np.flatnonzero(whole)
        key = grams(codes, n)[at]
        gram = np.minimum(np.searchsorted(items.keys, key), len(items.keys) - 1)
        known = items.keys[gram] == key
        at, gram = at[known], gram[known]
        if not len(at):
            return none
        owner, place = _spread(items.offsets[gram], items.offsets[gram + 1] - items.offsets[gram])
        h_at, h_gram, h_doc = at[owner], gram[owner], np.searchsorted(borders, at)[owner]
        h_item, h_place = items.item_of[place], items.at_of[place]
        order = np.lexsort((h_at, h_item, h_doc))
        h_at, h_gram, h_doc, h_item, h_place = (x[order] for x in (h_at, h_gram, h_doc, h_item, h_place))
        new = np.ones(len(h_at), dtype=bool)
        new[1:] = (h_doc[1:] != h_doc[:-1]) | (h_item[1:] != h_item[:-1]) | (np.abs(np.diff(h_at - h_place)) > drift) | (np.diff(h_at) > reach)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(h_at))
        group = np.cumsum(new) - 1
        by_gram = np.lexsort((h_gram, group))
        g, c = h_gram[by_gram], group[by_gram]
        fresh = np.ones(len(g), dtype=bool)
        fresh[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        enough = np.bincount(c[fresh], minlength=len(starts)) >= least
        a, b = starts[enough], ends[enough] - 1
        doc, item = h_doc[a], h_item[a]
        low = np.where(doc > 0, borders[np.maximum(doc - 1, 0)] + 1, 0) if len(borders) else np.zeros(len(doc), dtype=np.int64)
        high = np.append(borders, len(ids))[doc]
        first = np.maximum(low, h_at[a] - h_place[a] - drift)
        final = np.minimum(high, h_at[b] + items.lengths[item] - h_place[b] + drift)
        pieces = np.zeros(len(ids), dtype=np.int64)
        head, tail = np.array(numbers.head)[np.maximum(ids, 0)], np.array(numbers.tail)[np.maximum(ids, 0)]
        both = np.flatnonzero(head[:-1] & tail[1:])
        pairs, back = np.unique(ids[both] * len(numbers.words) + ids[both + 1], return_inverse=True)
        words = numbers.words
        pieces[both] = np.array([items.vocabulary.get(words[p // len(words)] + words[p % len(words)], 0) for p in pairs.tolist()], dtype=np.int64)[back]
        keep, at = [], 0
        ends = np.cumsum(final - first + items.lengths[item])
        while at < len(doc):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_words, "right")))
            keep.append(at + np.flatnonzero(_hopeful(items, numbers, ids, pieces, item[at:to], first[at:to], final[at:to], span)))
            at = to
        kept = np.concatenate(keep) if keep else np.zeros(0, dtype=np.int64)
        return doc[kept], item[kept], low[kept], first[kept], final[kept]

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        numbers = _Numbers(items)
        for batch in batches:
            if len(numbers) > 1_000_000:
                numbers = _Numbers(items)
            texts = batch.column(2).to_pylist()
            words = _WORDS.findall("\x00".join(fold(t.replace("\x00", " ")) for t in texts))
            ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
            wanted: dict[tuple[int, str], list[tuple[int, int]]] = defaultdict(list)
            for d, k, low, first, final in zip(*(x.tolist() for x in passages(items, numbers, ids, np.flatnonzero(ids == -1)))):
                # Documents that hold the same passage share one alignment.
                wanted[k, " ".join(words[first:final])].append((d, first - low))
            todo = []
            for k, text in wanted:
                exact = items.near(k)[0]
                spoken = text.split(" ")
                readings = [items.codes(k, spoken)]
                if not items.near(k)[2].keys().isdisjoint(spoken):
                    readings.append(items.codes(k, spoken, False))
                for seen, places in readings:
                    if promising(seen, span):
                        todo.append((([exact[w] for w in items.words[k]], seen), places, (k, text)))
            todo.sort(key=lambda x: len(x[0][1]))
            claimed: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
            for a in range(0, len(todo), many_at_once):
                part = todo[a : a + many_at_once]
                for claim, (_, places, key) in zip(claims([x[0] for x in part], span, share), part):
                    if claim:
                        for d, first in wanted[key]:
                            claimed[d].append((key[0], [first + places[j] for j in claim[1]]))
            ids_of, copies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if final_pairs:
                rows = [(ids_of[d], i) for d, c in claimed.items() for k in set(winners(c)) for i in items.ids[k]]
                schema = PAIRS
            else:
                rows = [(ids_of[d], copies[d], i, p) for d, c in claimed.items() for k, p in c for i in items.ids[k]]
                schema = CLAIMS
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    return op


def _doc_grams(n: int):
    """Documents -> (doc_id, copy, gram), each gram of words once a document; as words, which need no common codes."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, c, t in zip(*(batch.column(x).to_pylist() for x in range(3))):
                ws = _WORDS.findall(fold(t.replace("\x00", " ")))
                out += [(i, c, " ".join(g)) for g in {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}]
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "copy", "gram"])

    return op


def _beats(rows: pd.DataFrame) -> pd.DataFrame:
    claimed = [(i, list(p)) for i, p in zip(rows["item_id"], rows["places"])]
    kept = sorted(set(winners(claimed)))
    return pd.DataFrame({"doc_id": rows["doc_id"].iloc[0], "item_id": kept}).astype("int64")


def leaked_items(
    docs: DataFrame, doc_id: str, text: str, evals: DataFrame, item_id: str, item_text: str,
    n: int = 3, span: int = 15, share: float = 0.3, least: int = 2, drift: int = 12, reach: int = 40, block: int = 50_000,
) -> DataFrame:
    """Every (``doc_id``, ``item_id``) where the document holds at least ``span`` consecutive words of the item, edits allowed.

    1. Items are a stated query set. Up to ``block`` of them (some 30 MB of grams and words) are broadcast, and the documents
       are read once. Of more, the grams are joined with those of the documents first, and each block of items is searched for
       only in the documents that hold ``least`` grams of it: the documents are read twice, however many items there are.
    2. Each task looks the ``n``-grams of its documents up among those of the items. Where ``least`` of them lie near one
       diagonal, the passage around them is aligned with the item, word by word, unless its words cannot make up a stretch;
       how many documents or items hold an n-gram does not matter.
    3. It is a leak if a stretch of ``span`` words of the item is there in order with single words left out, put in or
       replaced, and scores at least ``share`` of them. Each pair is decided by its own alignment.
    4. Where items claim the same words of a document, an item gives way to one that matches more of the words in its
       stretch. So an item that only shares its phrasing with the one that leaked is not reported.

    Cases: NULL and empty texts hold nothing; items of fewer than ``n`` words or below ``span`` words are never found; items
    of the same words are found together; repeated rows give one result; very long texts are searched whole; empty tables
    give an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("copy"), F.col(text).alias("text")).where((F.length("text") > 0) & F.col("doc_id").isNotNull())
    wanted = evals.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id IS NOT NULL AND length(text) > 0")
    wanted = wanted.dropDuplicates(["item_id"])
    blocks = max(1, -(-wanted.count() // block))

    def held(part: DataFrame) -> Broadcast:
        return spark.sparkContext.broadcast(Items([(r.item_id, r.text) for r in part.orderBy("item_id").collect()], n))

    if blocks == 1:
        return spread(rows).mapInArrow(_search(held(wanted), drift, reach, least, span, share, True), "doc_id bigint, item_id bigint").distinct()
    # By their text, so that items of the same words meet in one block.
    wanted = cut_lineage(wanted.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int")))
    seeds = wanted.select("block", F.xxhash64("text").alias("copy"), "text").mapInArrow(_doc_grams(n), "doc_id bigint, copy bigint, gram string").select(F.col("doc_id").cast("int").alias("block"), "gram").distinct()
    met = rows.mapInArrow(_doc_grams(n), "doc_id bigint, copy bigint, gram string").join(seeds, "gram").groupBy("doc_id", "copy", "block").agg(F.countDistinct("gram").alias("n")).where(F.col("n") >= least)
    folder = scratch(spark, "leaks")
    rows.join(met.select("doc_id", "copy", "block"), ["doc_id", "copy"]).select("doc_id", "copy", "text", "block").write.partitionBy("block").parquet(folder)
    near = spark.read.schema("doc_id bigint, copy bigint, text string, block int").parquet(folder)
    out = None
    for b in range(blocks):
        found = near.where(F.col("block") == b).select("doc_id", "copy", "text").mapInArrow(_search(held(wanted.where(F.col("block") == b)), drift, reach, least, span, share, False), SPARK_CLAIMS)
        out = found if out is None else out.unionByName(found)
    # All claims of one text meet; their number is bounded by the words of the text and the items that share them.
    return out.groupBy("doc_id", "copy").applyInPandas(_beats, "doc_id bigint, item_id bigint").distinct()

"""Mapping free-entered citations to a reference list: a trie of names and aliases searched by a Levenshtein automaton."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.operators.skew import join_unique
from citeweave.runtime import cut_lineage, shuffle_partitions

#: Labels as they are typed, and what each stands for.
LABELS = {
    "art": "art", "artikel": "art", "article": "art", "articolo": "art", "§": "art",
    "abs": "abs", "absatz": "abs", "par": "abs", "al": "abs", "alinea": "abs", "cpv": "abs", "paragraph": "abs",
    "lit": "sub", "bst": "sub", "ziff": "sub", "ziffer": "sub", "let": "sub", "ch": "sub", "n": "sub", "nr": "sub",
}
#: Labels that are matched although misspelt by one edit.
FUZZY_LABELS = {"art": "art", "artikel": "art", "article": "art", "abs": "abs", "absatz": "abs"}
ROMAN = {"I": "1", "II": "2", "III": "3", "IV": "4", "V": "5", "VI": "6", "VII": "7", "VIII": "8", "IX": "9", "X": "10"}


class Trie:
    """Names with what they stand for; ``near`` walks it with the rows of a Levenshtein automaton (transpositions count once)."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, name: str, meaning: str) -> None:
        node = self.root
        for c in name:
            node = node.setdefault(c, {})
        node.setdefault("", set()).add(meaning)

    def near(self, word: str, most: int) -> list[tuple[int, str]]:
        """All (distance, meaning) with distance <= most."""
        found: dict[str, int] = {}
        width = len(word)

        def walk(node: dict, letter: str, before: str, row: list[int], earlier: list[int] | None) -> None:
            if "" in node and row[width] <= most:
                for meaning in node[""]:
                    found[meaning] = min(row[width], found.get(meaning, most))
            for c, child in node.items():
                if not c:
                    continue
                nxt = [row[0] + 1]
                for j in range(1, width + 1):
                    cost = min(nxt[j - 1] + 1, row[j] + 1, row[j - 1] + (word[j - 1] != c))
                    if earlier is not None and j > 1 and word[j - 1] == letter and word[j - 2] == c:
                        cost = min(cost, earlier[j - 2] + 1)
                    nxt.append(cost)
                if min(nxt) <= most or min(row) < most:
                    walk(child, c, letter, nxt, row)

        walk(self.root, "", "", list(range(width + 1)), None)
        return sorted((d, m) for m, d in found.items())


def allowed_distance(word: str) -> int:
    """Edits by length: short names are told apart by single letters, long ones are not."""
    return 0 if len(word) < 4 else 1 if len(word) < 12 else 2


_SUFFIX = r"(?:(?:bis|ter|quater|quinquies|sexies)(?![a-zà-ÿ])|(?:bis|ter|quater|[a-z])(?=abs)|[a-z](?![a-zà-ÿ]))?"
_CASE = re.compile(r"(?<![\w])(\d[a-z])[ _.\-]?(\d+)/((?:19|20)\d\d)", re.I)
_RECITAL = re.compile(r"(?<![^\W\d_])(?:erwägung|erw|consid|cons|e|c)\.?\s*(\d+(?:\.\d+)*)", re.I)
_REPORT = re.compile(r"(?<![\d.])(\d{2,3})[\s/]*(iv|i{1,3}|v)[\s/]*(\d+)(?![\d/])", re.I)
_SLASHED = re.compile(r"(?<!\S)([^\W\d_]+)\s+(\d+" + _SUFFIX + r")/(\d+" + _SUFFIX + r")", re.I)
_ROMAN = re.compile(r"(\d+[a-z]?)\s+([IVX]+)(?=\s)")
_NUMBERED = re.compile(r"([^\W\d_]+|§)[\s.]*(\d+\s?" + _SUFFIX + r")(?![\d/])")
_COLLECTION = re.compile(r"(?<![\d.])(\d{3}(?:\.\d+)+)(?![\d.])")
_BRACKET = re.compile(r"\([^()]*\)?|\[[^\[\]]*\]?")


def parser(trie: Trie, labels: Trie, reserved: Trie) -> Callable[[str], list[tuple[int, str]]]:
    """A function from a typed citation to the keys it may stand for, each with its distance; exact in every number.

    ``reserved``: names of laws that look like labels; a word near one is no misspelt label.
    """

    @lru_cache(maxsize=200_000)
    def law_of(word: str) -> tuple[tuple[int, str], ...]:
        return tuple(trie.near(word, allowed_distance(word)))

    @lru_cache(maxsize=50_000)
    def label_of(word: str) -> str | None:
        if word in LABELS:
            return LABELS[word]
        if len(word) < 3 or law_of(word) or reserved.near(word, allowed_distance(word)):
            return None
        near = labels.near(word, 1)
        return near[0][1] if near else None

    def statute(text: str) -> list[tuple[int, str]]:
        lowered = text.lower()
        laws = [(0, m) for sr in _COLLECTION.findall(lowered) for d, m in law_of(sr) if d == 0]
        rest = _COLLECTION.sub(" ", lowered)
        article = paragraph = None
        if slashed := _SLASHED.search(rest):
            if slashed[1] not in LABELS:
                article, paragraph = slashed[2], slashed[3]
                rest = rest[: slashed.start()] + " " + slashed[1] + " " + rest[slashed.end() :]
        spans = []
        for m in _NUMBERED.finditer(rest):
            kind = label_of(m[1])
            number = m[2].replace(" ", "")
            if kind == "art" and article is None:
                article = number
            elif kind == "abs" and paragraph is None:
                paragraph = number
            elif kind is None:
                continue
            spans.append(m.span())
        if article is None:
            return []
        for a, b in reversed(spans):
            rest = rest[:a] + " " + rest[b:]
        if not laws:
            words = re.findall(r"[^\W_]+(?:-[^\W_]+)*", rest)
            hits = [hit for w in words if not w.isdigit() for hit in law_of(w)]
            least = min((d for d, _ in hits), default=None)
            laws = sorted({h for h in hits if h[0] == least})
        return [(d, f"S|{law}|{article}|{paragraph or ''}") for d, law in laws]

    def parse(typed: str) -> list[tuple[int, str]]:
        text = re.sub(r"[«»„“”\"]", " ", unicodedata.normalize("NFKC", typed)).strip()
        text = re.sub(r"(?<=\d)[Oo](?![^\W\d_]{2})|(?<![^\W_])[Oo](?=\d)", "0", text)
        text = re.sub(r"(?<=\d)[Oo](?=\d|[a-z]?\b)", "0", text)
        bare = _BRACKET.sub(" ", text)
        for form in (bare, re.sub(r"[()\[\]]", " ", text)):
            recital = None
            if case := _CASE.search(form):
                recital = _RECITAL.search(form, case.end()) or _RECITAL.search(form)
                return [(0, f"C|{case[1].upper()}_{int(case[2])}/{case[3]}|{recital[1]}")] if recital else []
            if report := _REPORT.search(form):
                recital = _RECITAL.search(form, report.end()) or _RECITAL.search(form[: report.start()])
                if recital:
                    return [(0, f"R|{int(report[1])}|{report[2].upper()}|{int(report[3])}|{recital[1]}")]
            spoken = _ROMAN.sub(lambda m: f"{m[1]} abs {ROMAN[m[2]]} " if m[2] in ROMAN else m[0], form)
            if keys := statute(spoken):
                return keys
        return []

    return parse


#: Entries (and their aliases) that one task holds as a trie, some 200 MB; longer lists are searched in shards of laws.
MOST_ENTRIES = 200_000

Entry = tuple[int, str, str | None, str | None]


def law_id(citation: str, sr: str | None) -> str:
    """A law is its short name and number; under one short name and number all full names name one law."""
    short = unicodedata.normalize("NFKC", citation).split()[-1].lower() if citation.split() else ""
    return f"{short}/{sr}" if sr else short


def _aliases(citation: str, name: str | None, sr: str | None) -> list[str]:
    """Short name, full name and number of an entry's law; none for a decision."""
    if not name and not sr:
        return []
    words = unicodedata.normalize("NFKC", citation).split()
    return [a for a in (words[-1].lower() if words else "", unicodedata.normalize("NFKC", name or "").lower(), sr or "") if a]


class Reference:
    """A trie of the entries: every alias of a law is a path to the law, and from there each article and paragraph leads to
    its entries; decisions are met by their numbers. Aliases are walked by the Levenshtein automaton, numbers exactly."""

    def __init__(self, entries: list[Entry], reserved: list[str]) -> None:
        trie, labels, names = Trie(), Trie(), Trie()
        for _, citation, name, sr in entries:
            for alias in _aliases(citation, name, sr):
                trie.add(alias, law_id(citation, sr))
        for label, kind in FUZZY_LABELS.items():
            labels.add(label, kind)
        for alias in reserved:
            names.add(alias, alias)
        self.parse = parser(trie, labels, names)
        self.entries: dict[str, int] = {}
        for i, citation, name, sr in entries:
            own = f"S|{law_id(citation, sr)}|"
            for distance, key in self.parse(citation):
                if distance == 0 and (key.startswith(own) if name or sr else not key.startswith("S|")):
                    self.entries[key] = min(i, self.entries.get(key, i))

    def find(self, typed: str) -> list[tuple[int, int]]:
        """(distance, entry) of all readings; 0 is a law that has no such entry."""
        return sorted({(d, self.entries.get(key, 0)) for d, key in self.parse(typed)})


#: The trie of a broadcast list, built once a worker.
_BUILT: dict[int, Reference] = {}


def _find_all(shared: Broadcast, key: int):
    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Reference(*shared.value)
        reference = _BUILT[key]
        for batch in batches:
            out = [(v, d, i) for v in batch["_value"] for d, i in reference.find(v)]
            yield pd.DataFrame(out, columns=["_value", "distance", "id"])

    return op


def map_to_reference(df: DataFrame, value: str, reference: DataFrame) -> DataFrame:
    """``df`` with ``canonical_id``: the entry of ``reference`` that ``value`` names, 0 if none.

    1. The entries go to every task as a trie (at most MOST_ENTRIES, checked; longer lists in shards, all entries of a law in
       one, each searched in turn). All short and full names and numbers of a law are alias paths.
    2. Every distinct value is read once, over all cores: numbers exactly, the law's name within the length-dependent
       distance of an alias. The nearest reading wins; if it leads to two entries, the value names neither for sure and gets 0.
    3. Rows meet their value's result by a join that leaves hot values where they are.

    Cases: a NULL or blank value names nothing (0); very long values are read whole; repeated rows stay repeated; an
    empty table gives an empty result; entries of one meaning resolve to the least id; laws of one short name and different
    numbers are told apart by their full names and numbers.
    """
    spark = df.sparkSession
    entries = reference.where("canonical_id IS NOT NULL AND canonical_citation IS NOT NULL").select(F.col("canonical_id").cast("long"), "canonical_citation", "law_name", "sr_number")
    shards = max(1, -(-entries.count() // MOST_ENTRIES))
    law = F.when(F.col("law_name").isNull() & F.col("sr_number").isNull(), F.col("canonical_citation")).otherwise(F.concat_ws("/", F.lower(F.element_at(F.split("canonical_citation", " "), -1)), "sr_number"))
    entries = entries.withColumn("_shard", F.pmod(F.xxhash64(law), F.lit(shards)))
    reserved: list[str] = []
    if shards > 1:
        entries = cut_lineage(entries)
        name = F.lower(F.element_at(F.split("canonical_citation", " "), -1))
        like = F.exists(F.array(*[F.lit(x) for x in FUZZY_LABELS]), lambda x: F.levenshtein(name, x) <= 2)
        # Names this short and this near to five words are few, whatever the length of the list.
        reserved = [r[0] for r in entries.where(F.col("law_name").isNotNull() | F.col("sr_number").isNotNull()).where(like).select(name).distinct().collect()]
    rows = cut_lineage(df.withColumn("_value", F.coalesce(F.col(value).cast("string"), F.lit(""))))
    values = rows.select("_value").distinct()
    spread = values.repartition(max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism), "_value")
    spread = cut_lineage(spread) if shards > 1 else spread
    found = None
    for k in range(shards):
        part = [tuple(r) for r in entries.where(F.col("_shard") == k).drop("_shard").collect()]
        near = spread.mapInPandas(_find_all(spark.sparkContext.broadcast((part, reserved)), uuid.uuid4().int), "_value string, distance int, id long")
        found = near if found is None else found.unionByName(near)
    best = found.groupBy("_value", "distance").agg(F.collect_set("id").alias("_ids")).groupBy("_value").agg(F.min_by("_ids", "distance").alias("_ids"))
    named = best.select("_value", F.array_remove("_ids", F.lit(0).cast("long")).alias("_ids")).where(F.size("_ids") == 1).select("_value", F.col("_ids")[0].alias("canonical_id"))
    lookup = cut_lineage(values.join(named, "_value", "left").select("_value", F.coalesce("canonical_id", F.lit(0)).cast("long").alias("canonical_id")))
    return join_unique(rows.drop("canonical_id"), lookup, "_value").drop("_value")

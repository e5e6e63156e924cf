"""Personal information in free text, by information-theoretic sanitisation: corpus co-occurrence estimates how strongly terms
reveal a person; what exceeds a threshold of disclosure is replaced by its type."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm import patterns
from citeweave.llm.leaks import fold
from citeweave.operators.skew import join_unique
from citeweave.runtime import cut_lineage, spread

KINDS = ("email", "phone", "identity", "address", "person")

ROWS = pa.schema([
    ("doc_id", pa.int64()), ("copy", pa.int64()), ("at", pa.int32()), ("pii_type", pa.string()), ("found_text", pa.string()), ("contexts", pa.list_(pa.string())), ("terms", pa.list_(pa.string())), ("words", pa.int32()), ("doubtful", pa.bool_()),
    ("total", pa.int64()), ("protected", pa.int64()), ("firm", pa.int64()),
])
SPARK_ROWS = "doc_id bigint, copy bigint, at int, pii_type string, found_text string, contexts array<string>, terms array<string>, words int, doubtful boolean, total bigint, protected bigint, firm bigint"

#: Exact and near contexts of a passage: the two words before, the one before and the one after, the two words after.
BEFORE, BETWEEN, AFTER = "<", "=", ">"
_PARTS = re.compile(r"[^\W\d_]{3,}")


def passages(text: str) -> tuple[set[tuple[str, str]], list[tuple[int, int]], list[tuple[int, int]]]:
    """(type, passage) of what its notation gives away, the spans of names that a cue announces, and all spans taken."""
    places = patterns.places(text)
    mails = list(patterns.mails(text, places.get("mail", [])))
    found = {("email", text[a:b]) for a, b in mails}
    found.update((kind, text[a:b]) for kind, a, b in patterns.numbers(text))
    streets = list(patterns.streets(text, places))
    found.update(("address", text[a:b]) for a, b in streets)
    cued = list(patterns.names(text, places.get("cue", [])))
    return found, [(a, b) for a, b, _ in cued], sorted([*mails, *streets, *((a, b) for a, b, initial in cued if not initial)])


#: A run of capitalised words and the names that may end there: (run, whether a firm, end, [(begin, words, terms, doubtful)]).
Run = tuple[str, bool, int, list[tuple[int, int, list[str], bool]]]


def uncued(text: str, taken: list[tuple[int, int]]) -> Iterator[Run]:
    """Every run of capitalised words, with the names that it could hold though nothing announces them."""
    firm_after, firm_in = patterns.FIRM.match, patterns.FIRM.search
    k, end = 0, len(taken)
    for a, b in patterns.capital_runs(text):
        while k < end and taken[k][1] <= a:
            k += 1
        alone = k == end or taken[k][0] >= b
        phrase = text[a:b]
        many = " " in phrase or "\xa0" in phrase
        firm = bool(firm_after(text, b) or many and firm_in(phrase))
        yield phrase, firm, b, patterns.name_ends(text, a, b) if alone and many and not firm else []
        if alone and not firm and text[b : b + 1] == "," and (listed := patterns.family_first(text, a, b)) and not firm_after(text, listed[0]):
            yield "", False, *listed


def contexts(text: str, at: int, b: int, words: int) -> list[str]:
    """What stands around a passage, as far as it may tell that a name begins here: what stands behind tells it only of the
    shortest names and of whole sentence beginnings, and not of "M."."""
    left, right = patterns.context(text, at, b)
    near = [BEFORE + left, f"{BETWEEN}{left.rpartition(' ')[2]}|{right.partition(' ')[0]}"]
    if text.startswith("M. ", at) or words > 2 and not patterns.begins_sentence(text, at, b):
        return near
    return [*near, AFTER + right]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> passages of each type, names announced by a cue (``cue``), names that other runs of capitalised words
    may hold, with their contexts (``run``), and for each batch how often every capitalised term stands anywhere, with a
    protected entity and in firms (``term``). With a protected entity means: in a name that is announced, or in a text
    whose mail addresses hold the term."""
    for batch in batches:
        out: list[tuple] = []
        runs, cued, firm, linked = Counter(), Counter(), Counter(), Counter()
        for doc, copy, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            found, spans, taken = passages(text)
            out += [(doc, copy, None, kind, passage, *[None] * 7) for kind, passage in found]
            for a, b in spans:
                out.append((doc, copy, b, "cue", text[a:b], None, patterns.terms(text[a:b]), 1, False, None, None, None))
                cued[text[a:b]] += 1
            held = {p for kind, m in found if kind == "email" for p in _PARTS.findall(fold(re.split(r"@|[(\[]", m)[0]))}
            announced = {t for a, b in spans for t in patterns.terms(text[a:b])} if held else set()
            for phrase, is_firm, b, ends in uncued(text, taken):
                if phrase:
                    runs[phrase] += 1
                if is_firm:
                    firm[phrase] += 1
                elif held and phrase:
                    for t in patterns.terms(phrase):
                        if fold(t) in held and t not in announced:
                            linked[t] += 1
                for at, words, terms, doubtful in ends:
                    out.append((doc, copy, b, "run", text[at:b], contexts(text, at, b, words), terms, words, doubtful, None, None, None))
        tallies: list[Counter] = []
        for counts in (runs, cued, firm):
            by_term: Counter = Counter()
            for phrase, n in counts.items():
                for t in patterns.terms(phrase):
                    by_term[t] += n
            tallies.append(by_term)
        total, cued, firm = tallies
        cued.update(linked)
        out += [(None, None, None, "term", t, None, None, None, None, total.get(t, 0), cued.get(t, 0), firm.get(t, 0)) for t in total.keys() | cued.keys()]
        cols = list(zip(*out)) if out else [[] for _ in ROWS]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, ROWS)], schema=ROWS)


def _shares(counts: DataFrame) -> tuple[DataFrame, Column]:
    """term, share: of all occurrences outside firms, those with a protected entity; and the share over all terms."""
    return counts.where("protected > 0").select("term", (F.col("protected") / F.greatest(F.col("total") - F.col("firm"), F.col("protected"), F.lit(1))).alias("share"))


def _judged(phrases: DataFrame, shares: DataFrame) -> DataFrame:
    """Of every distinct phrase the highest and the least share of its terms."""
    one = phrases.groupBy("found_text").agg(F.any_value("terms").alias("terms")).select("found_text", F.explode("terms").alias("term"))
    return one.join(shares, "term", "left").groupBy("found_text").agg(F.max(F.coalesce("share", F.lit(0.0))).alias("most"), F.min(F.coalesce("share", F.lit(0.0))).alias("least"))


def disclosing_names(
    seen: DataFrame, cue_share: float = 0.2, cue_bits: float = 2.0, run_share: float = 0.6, seed_share: float = 0.25, context_share: float = 0.3, context_names: int = 3
) -> tuple[DataFrame, DataFrame]:
    """``found_text`` of all names, announced or not, whose terms exceed the thresholds of disclosure; and the contexts that
    reveal names, with the number of names seen in each. ``seen``: rows of a scan.

    What a term reveals is the share of its occurrences with a protected entity, and by how many bits that exceeds the
    share over the whole corpus (pointwise mutual information). It is estimated twice: first from announced names and mail
    addresses; then also from wordings around names, which the first estimate finds: a context is revealing if at least
    ``context_names`` distinct names (all terms with ``seed_share``) stand in it and they are ``context_share`` of all
    candidates there. An announced name is kept if some term of it reveals a person (``cue_share`` and ``cue_bits``), any
    other only if all its terms do (``run_share``).

    Counts cover all documents and are combined on the map side; hot terms and contexts cost a row a task.
    """
    counts = seen.where("pii_type = 'term'").groupBy(F.col("found_text").alias("term")).agg(*[F.sum(c).alias(c) for c in ("total", "protected", "firm")])
    counts = cut_lineage(counts)
    runs = seen.where("pii_type = 'run'").select("doc_id", "copy", "at", "found_text", "terms", "contexts")
    first = _judged(runs, _shares(counts)).where(F.col("least") >= seed_share).select("found_text", F.lit(1).alias("named"))
    met = runs.select("found_text", F.explode("contexts").alias("context")).distinct().join(first, "found_text", "left")
    revealing = met.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.count("named").alias("named")).where((F.col("named") >= context_names) & (F.col("named") >= context_share * F.col("n")))
    revealing = cut_lineage(revealing.select("context", "named"))
    placed = runs.select("doc_id", "copy", "at", "terms", F.explode("contexts").alias("context")).join(revealing, "context", "left_semi").select("doc_id", "copy", "at", F.explode("terms").alias("term")).distinct()
    more = placed.groupBy("term").agg(F.lit(0).cast("long").alias("total"), F.count(F.lit(1)).alias("protected"), F.lit(0).cast("long").alias("firm"))
    counts = cut_lineage(counts.unionByName(more).groupBy("term").agg(*[F.sum(c).alias(c) for c in ("total", "protected", "firm")]))
    base = counts.agg((F.sum("protected") / F.sum("total")).alias("base")).select(F.coalesce("base", F.lit(1.0))).first()[0]
    shares = _shares(counts)
    # Where most capitalised words are names, a name tells fewer bits: half of what the base rate leaves is enough.
    bits = min(cue_bits, -math.log2(max(base, 1e-12)) / 2)
    known = _judged(seen.where("pii_type = 'cue'"), shares).where((F.col("most") >= cue_share) & (F.log2(F.col("most") / base) >= bits))
    other = _judged(runs, shares).where(F.col("least") >= run_share)
    kept = known.select("found_text", F.lit(True).alias("cue"), F.lit(False).alias("run")).unionByName(other.select("found_text", F.lit(False).alias("cue"), F.lit(True).alias("run")))
    return kept.groupBy("found_text").agg(F.max("cue").alias("cue"), F.max("run").alias("run")), revealing


#: Of the names that end at one place: the one of most words, of equal words the one that begins where most names do, then one
#: that is announced elsewhere as it stands.
_ORDER = ("words", "support", "cue", "length")


def _chosen(rows: DataFrame, revealing: DataFrame) -> DataFrame:
    """``rows`` of disclosing names with their contexts -> one name for every place where names end."""
    support = rows.select("doc_id", "copy", "at", "found_text", F.explode("contexts").alias("context")).distinct().join(revealing, "context")
    support = support.groupBy("doc_id", "copy", "at", "found_text").agg(F.sum(F.when(F.left("context", F.lit(1)) != AFTER, F.col("named"))).alias("support"), F.lit(True).alias("placed"))
    rows = rows.join(support, ["doc_id", "copy", "at", "found_text"], "left").where("NOT doubtful OR placed")
    rows = rows.withColumns({"support": F.coalesce("support", F.lit(0)), "length": F.length("found_text")})
    return rows.groupBy("doc_id", "copy", "at").agg(F.max_by("found_text", F.struct(*_ORDER)).alias("found_text"))


def _rows(docs: DataFrame, doc_id: str, text: str, nameless: bool = False) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("copy"), F.col(text).alias("text"))
    return spread(rows.where((F.length("text") > 0) & (F.lit(nameless) | F.col("doc_id").isNotNull())))


def find_personal(docs: DataFrame, doc_id: str, text: str, bits: dict[str, float] | None = None, **thresholds: float) -> DataFrame:
    """``doc_id``, ``pii_type`` (email, phone, identity, address, person), ``found_text``: each passage once a document.

    1. One pass over the texts finds passages by their notation, names that a form of address, a title, a role or a
       signature announces, and all other runs of capitalised words; and counts every capitalised term.
    2. ``disclosing_names`` judges each distinct name by what its terms reveal; of the names that end at one place the
       longest disclosing one counts. Verdicts reach the rows by a join that leaves hot names where they are.
    3. ``bits`` sets for a type how many bits a passage must tell about its document (log2 of all documents over those that
       hold it); a type without a threshold is always kept.

    Cases: NULL and empty texts hold nothing; repeated rows give one result; a NULL id is left out; very long texts are
    scanned whole; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = _rows(docs, doc_id, text)
    seen = cut_lineage(rows.mapInArrow(_scan, SPARK_ROWS))
    kept, revealing = disclosing_names(seen, **thresholds)
    names = cut_lineage(seen.where("pii_type IN ('cue', 'run')").select("doc_id", "copy", "at", "found_text", "pii_type", "contexts", "words", "doubtful"))
    names = join_unique(names, cut_lineage(kept), "found_text").where("pii_type = 'cue' AND cue OR pii_type = 'run' AND run")
    persons = _chosen(cut_lineage(names), revealing).select("doc_id", F.lit("person").alias("pii_type"), "found_text")
    others = seen.where(F.col("pii_type").isin(*KINDS)).select("doc_id", "pii_type", "found_text")
    found = others.unionByName(persons).distinct()
    if not bits:
        return found
    held = found.groupBy("pii_type", "found_text").agg(F.count(F.lit(1)).alias("_n"))
    least = F.coalesce(*[F.when(F.col("pii_type") == k, F.lit(float(b))) for k, b in bits.items()], F.lit(0.0))
    telling = held.where(F.log2(F.lit(float(max(1, rows.count()))) / F.col("_n")) >= least).select("pii_type", "found_text")
    return found.join(telling, ["pii_type", "found_text"]).select("doc_id", "pii_type", "found_text")


def _sanitise(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    announced, open_, support = shared.value
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            if not text:
                out.append(text)
                continue
            found, spans, taken = passages(text)
            best: dict[int, tuple[tuple[int, int, bool, int], str]] = {b: ((1, 0, True, b - a), text[a:b]) for a, b in spans if text[a:b] in announced}
            for _, _, b, ends in uncued(text, taken):
                for at, words, _, doubtful in ends:
                    phrase = text[at:b]
                    if phrase not in open_:
                        continue
                    met = [(c, support[c]) for c in contexts(text, at, b, words) if c in support]
                    if met or not doubtful:
                        best[b] = max(best.get(b, ((0, 0, False, 0), "")), ((words, sum(n for c, n in met if c[0] != AFTER), phrase in announced, len(phrase)), phrase))
            out.append(mask(text, [{"pii_type": k, "found_text": p} for k, p in found | {("person", p) for _, p in best.values()}]))
        yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


#: Distinct names and contexts that are handed to every task, some 100 MB.
MOST_NAMES = 1_000_000


def redact_personal(docs: DataFrame, doc_id: str, text: str, **thresholds: float) -> DataFrame:
    """``doc_id``, ``text`` of all rows (also those without an id) with every personal passage replaced by its type, as in ``[EMAIL]``.

    Texts are read twice and never shuffled: the first pass gives the disclosing names, the second masks each text where it
    is read. More than MOST_NAMES distinct names (checked) meet the texts by ``redact`` instead. Cases: NULL and empty texts
    stay as they are; a repeated id with another text is masked by its own passages.
    """
    seen = cut_lineage(_rows(docs, doc_id, text, True).mapInArrow(_scan, SPARK_ROWS))
    kept, revealing = disclosing_names(seen, **thresholds)
    rows = kept.limit(MOST_NAMES + 1).collect()
    wordings = revealing.limit(MOST_NAMES + 1).collect()
    if max(len(rows), len(wordings)) > MOST_NAMES:
        return redact(docs, doc_id, text, find_personal(docs, doc_id, text, **thresholds))
    verdicts = frozenset(r.found_text for r in rows if r.cue), frozenset(r.found_text for r in rows if r.run), {r.context: r.named for r in wordings}
    names = docs.sparkSession.sparkContext.broadcast(verdicts)
    rows = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    return rows.mapInArrow(lambda batches: _sanitise(names, batches), "doc_id bigint, text string")


def redact(docs: DataFrame, doc_id: str, text: str, found: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` with every found passage replaced by its type, as in ``[EMAIL]``; the rest stays as it is.

    Cases: a document without findings, a NULL or an empty text stay as they are; longer passages go first; a passage is
    replaced wherever it stands by itself; of two types of one passage the first in the alphabet names it.
    """
    lists = found.groupBy(F.col("doc_id")).agg(F.collect_list(F.struct("pii_type", "found_text")).alias("_found"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(lists, "doc_id", "left")

    masked = F.pandas_udf(_masked, "string")
    return rows.select("doc_id", F.when(F.col("_found").isNull(), F.col("text")).otherwise(masked("text", "_found")).alias("text"))


def _masked(texts: pd.Series, findings: pd.Series) -> pd.Series:
    return pd.Series([mask(t, f) for t, f in zip(texts, findings)])


def mask(text: str | None, findings) -> str | None:
    if text is None or findings is None or not len(findings):
        return text
    kinds = {f["found_text"]: f["pii_type"] for f in sorted(findings, key=lambda f: f["pii_type"], reverse=True)}
    pattern = "|".join(re.escape(p) for p in sorted(kinds, key=len, reverse=True))
    return re.sub(rf"(?<!\w)(?:{pattern})(?!\w)", lambda m: f"[{kinds[m[0]].upper()}]", text)

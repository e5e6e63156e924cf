"""Where personal information stands in free text: notations of addresses and numbers, and the cues that announce a name."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick

_S = "[ \xa0]"
_SEP = "[ \xa0./\\-]"

#: The signs between mailbox and domain; the mailbox is read backwards from one, the domain forwards.
AT = ("@", "(at)", "[at]", "(AT)", "[AT]")
_MAILBOX = re.compile(r"[\w.+\-]+ ?\Z")
_DOMAIN = re.compile(r" ?[\w\-]+(?:(?:\.| ?[(\[](?:dot|DOT|punkt|PUNKT|point|POINT|punto|PUNTO)[)\]] ?)[\w\-]+)+")

#: Telephone and identity numbers; the kind is the name of the group.
NUMBERS = re.compile(
    rf"(?P<identity>756(?P<d>{_SEP}?)\d{{4}}(?P=d)\d{{4}}(?P=d)\d\d"
    rf"|[12]{_S}\d\d{_S}\d\d{_S}\d\d{_S}\d{{3}}{_S}\d{{3}}{_S}\d\d"
    rf"|[A-Z]{{2}}{_S}?\d\d{_S}?\d\d{_S}?\d\d{_S}?[A-D]|[A-Z]\d[A-Z0-9]\d{{5}})(?![\w])"
    rf"|(?P<phone>(?:\+41|0041){_SEP}?(?:\(0\){_S}?)?\d\d{_SEP}?\d{{3}}{_SEP}?\d\d{_SEP}?\d\d"
    rf"|\+1{_SEP}?\(?\d{{3}}\)?{_SEP}?\d{{3}}{_SEP}?\d{{4}}"
    rf"|(?:\+|00)\d\d{_SEP}?(?:\(0\){_S}?)?\d{{1,4}}(?:{_SEP}?\d{{2,5}}){{2,4}}"
    rf"|\(?0\d\d\)?{_SEP}?\d{{3}}{_SEP}?\d\d{_SEP}?\d\d|0\d(?:{_SEP}?\d\d){{4}}"
    rf"|\(?0\d\d\)?{_SEP}?\d{{4}}{_SEP}?\d{{4}}|\(?0\d\d\d?\)?{_SEP}\d{{5}}{_SEP}?\d{{3}})(?![\w])"
)

_HOUSE = rf"\d{{1,3}}(?:{_S}?[a-eA-E])?(?![\w])"
_CAP = "[A-ZÀ-Þ][\\w'’.\\-]*"
#: Endings of street names written as one word, keywords before a street name, and keywords after one.
ENDINGS = ("weg", "strasse", "straße", "str.", "gasse", "platz", "matte", "halde", "rain", "steig", "graben", "hof", "gässli", "allee", "ufer", "damm", "promenade")
FIRST_WORDS = ("rue", "place", "avenue", "chemin", "quai", "route", "ruelle", "boulevard", "allée", "impasse", "sentier", "via", "piazza", "contrada", "salita", "viale", "vicolo", "corso", "largo")
LAST_WORDS = ("Road", "Avenue", "Lane", "Street", "Close", "Drive", "Row", "Square", "Court", "Terrace", "Crescent", "Gardens", "Way", "Place", "Hill", "Mews", "Yard", "Grove")
_LEAD = rf"(?:Im|Am|An{_S}der|Auf{_S}der|In{_S}der|Zum|Zur|Bei{_S}der|Bei|(?:Unter|Ober|Hinter|Vorder|Mittler|Alt|Neu|Klein|Gross)er?e?r?|IM|AM|AN{_S}DER|UNTERER|OBERER)"
_OF = rf"(?:{_S}+(?:de{_S}la|des|du|de|la|le|les|dei|della|delle|degli|del|alla|alle|al|ai))?(?:{_S}+[dl]['’])?{_S}*"


def _either(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in words)


_ENDED = re.compile(rf"(?:{_either(ENDINGS)}|{_either(tuple(e.upper() for e in ENDINGS))}){_S}+(?:(?:Nr\.|NR\.|No\.){_S}*)?{_HOUSE}")
_ENDED_START = re.compile(rf"(?:(?<!\w){_LEAD}{_S}+)?[A-ZÄÖÜ][\w\-]*\Z")
_FIRST = _either(FIRST_WORDS + tuple(w.capitalize() for w in FIRST_WORDS))
_STREET_NUMBER = re.compile(rf"(?:{_FIRST}){_OF}{_CAP}(?:{_S}+{_CAP})*?,?{_S}+{_HOUSE}")
_NUMBER_STREET = re.compile(rf"\d{{1,3}}(?:{_S}?[a-eA-E])?,{_S}*(?:{_FIRST}){_OF}{_CAP}(?!\w)")
_NUMBER_NAME = re.compile(rf"\d{{1,3}}(?:{_S}?[a-eA-E])?{_S}+(?:{_CAP}{_S}+){{1,3}}?(?:{_either(LAST_WORDS)})(?!\w)")

_PART = "(?:de|di|da|del|van der|van|von|zu|der|De|Di|Da|Del|Van der|Van|Von|DE|DI|DA|DEL|VAN DER|VAN|VON)"
_WORD = "(?:[dD]['’])?[A-ZÀ-Þ][\\w’']*(?:-(?:[dD]['’])?[A-ZÀ-Þ][\\w’']*)*"
#: A personal name: family name, comma, given name (no number follows); or given and family names, initials and particles in
#: any order.
NAME = (
    rf"(?:(?:{_PART}{_S}+)?{_WORD},{_S}+{_WORD}(?:{_S}+[A-ZÀ-Þ]\.)?(?![\w’'-])(?!\.?{_S}*[\d(+:])"
    rf"|(?:{_PART}{_S}+)?(?:[A-ZÀ-Þ]\.(?!_)|{_WORD})(?:{_S}+(?:[A-ZÀ-Þ]\.(?!_)|(?:{_PART}{_S}+)?{_WORD}))*)"
)
_TITLE = rf"(?:(?:Dr|Prof|lic|iur|med|PhD|MLaw|Ing|Mag|avv|Avv|dott|Dott)\.{_S}*)*"
#: What announces a name in any text: forms of address, titles, roles, signatures. Other wordings are learned from the corpus.
CUES = (
    "Herr", "Herrn", "Frau", "Fräulein", "Zeuge", "Zeugin", "Rechtsanwalt", "Rechtsanwältin", "Fürsprecher", "Fürsprecherin", "Sachbearbeitung:", "Sachbearbeiterin:", "Sachbearbeiter:", "gez.",
    "Mme", "M.", "MM.", "Mlle", "Me", "Maître", "Monsieur", "Madame", "témoin",
    "signora", "signor", "Sig.ra", "Sig.", "teste", "testimone", "Firmato",
    "Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Ms.", "Miss", "Sir", "witness", "Signed,", "counsel for the defendant,", "counsel for the plaintiff,",
    "Dr.", "Prof.", "lic. iur.", "avv.", "Avv.", "dott.", "Dott.",
)
_ANNOUNCED = re.compile(rf"{_S}+{_TITLE}(?P<name>{NAME})")
#: What follows the name of a firm.
FIRM = re.compile(rf"{_S}*(?:&|(?<!\w)(?:AG\b|GmbH\b|SA\b|Sàrl\b|Sagl\b|KG\b|Co\.|Holding\b|Genossenschaft\b|Ltd\b|Inc\b|LLC\b|Stiftung\b|Verein\b|Söhne\b|Partner\b|et{_S}Cie))")


def _keywords() -> ahocorasick.Automaton:
    """All literals that may stand at a passage, found in one pass over a text."""
    found: dict[str, set[str]] = {}
    for e in ENDINGS:
        for form in (e, e.upper()):
            for blank in " \xa0":
                found.setdefault(form + blank, set()).add("ended")
    for w in FIRST_WORDS:
        for form in (w, w.capitalize()):
            # "salita all'Orto", "via d'Orso": what follows the keyword is left to the pattern.
            found.setdefault(form, set()).add("first")
    for kind, words in (("last", LAST_WORDS), ("cue", CUES), ("mail", AT)):
        for w in words:
            found.setdefault(w, set()).add(kind)
    automaton = ahocorasick.Automaton()
    for word, kinds in found.items():
        automaton.add_word(word, (len(word), tuple(sorted(kinds))))
    automaton.make_automaton()
    return automaton


_AUTOMATON: list[ahocorasick.Automaton] = []


def places(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the keywords of each kind."""
    if not _AUTOMATON:
        _AUTOMATON.append(_keywords())
    out: dict[str, list[tuple[int, int]]] = {}
    for last, (size, kinds) in _AUTOMATON[0].iter(text):
        for kind in kinds:
            out.setdefault(kind, []).append((last + 1 - size, last + 1))
    return out


def mails(text: str, at: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for a, b in at:
        before = _MAILBOX.search(text, max(0, a - 100), a)
        after = _DOMAIN.match(text, b)
        if before and after:
            yield before.start(), after.end()


#: Any stretch that could hold a number of either kind; most text has none, so the exact notations are tried only here.
_DIGITS = re.compile(r"\d(?:[\d \xa0.()/\-]{6,}\d|\d{4,})")


def numbers(text: str) -> Iterator[tuple[str, int, int]]:
    for near in _DIGITS.finditer(text):
        for m in NUMBERS.finditer(text, max(0, near.start() - 4), min(len(text), near.end() + 3)):
            a, b = m.span()
            if a and (text[a - 1].isalnum() or text[a - 1] in "+_" or text[a - 1] in "./-" and a > 1 and text[a - 2].isdigit()):
                continue
            if text[b : b + 1] in ("/", "-", ".") and text[b + 1 : b + 2].isdigit():
                continue
            yield "phone" if m["phone"] else "identity", a, b


_NUMBER_BEFORE = re.compile(rf"\d{{1,3}}(?:{_S}?[a-eA-E])?,{_S}*\Z")


def streets(text: str, found: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[int, int]]:
    """Word order by keyword: street as one word and number, keyword first, or number first; each tried only where a
    keyword stands."""

    def free(a: int) -> bool:
        return not a or not (text[a - 1].isalnum() or text[a - 1] in "./-'’_")

    for a, _ in found.get("ended", ()):
        if m := _ENDED.match(text, a):
            start = _ENDED_START.search(text, max(0, a - 60), a)
            if start and free(start.start()):
                yield start.start(), m.end()
    for a, _ in found.get("first", ()):
        if free(a) and (m := _STREET_NUMBER.match(text, a)):
            yield m.span()
        elif before := _NUMBER_BEFORE.search(text, max(0, a - 24), a):
            if free(before.start()) and (m := _NUMBER_STREET.match(text, before.start())):
                yield m.span()
    seen = 0
    for a, b in found.get("last", ()):
        if b > seen:
            for m in _NUMBER_NAME.finditer(text, max(seen, a - 120), min(len(text), b + 1)):
                if free(m.start()):
                    yield m.span()
                    seen = m.end()


def names(text: str, cues: list[tuple[int, int]]) -> Iterator[tuple[int, int, bool]]:
    """Spans announced by a cue, and whether the cue is an initial as well; a name ends where a firm's name goes on. Of cues in
    a row ("Herr Dr.") the first reads the whole name."""
    last = -1
    for a, b in sorted(cues):
        if a < last or a and (text[a - 1].isalnum() or text[a - 1] == "_"):
            continue
        m = _ANNOUNCED.match(text, b)
        if m:
            last = m.end("name")
            if not FIRM.match(text, last):
                yield *m.span("name"), text[a:b] == "M."


#: Words that begin sentences or join nouns; a name does not begin with one.
COMMON = frozenset(
    "der die das des dem den ein eine einer eines und oder im am an auf aus bei mit nach von vom zu zum zur für gegen ohne um durch über unter vor wer ob soweit laut gemäss daran dass weil wenn "
    "le la les un une des du de et ou ni si il elle ce cette selon dans sur pour par aux au quiconque "
    "il lo la i gli le un una e o di da del della chi se nel con per ai secondo resta bastano "
    "the a an of to in on at by for from with under and or no if is it this that whether either costs".split()
)
_CAPITAL = "[A-ZÀ-Þ](?:\\.(?!_)|[\\w’']*(?:-(?:[dD]['’])?[A-ZÀ-Þ][\\w’']*)*)"
_RUN = re.compile(rf"{_CAPITAL}(?:{_S}+(?:(?:{_PART}{_S}+)?(?:[dD]['’])?{_CAPITAL}))*")


def capital_runs(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of capitalised words: all terms whose co-occurrence is counted."""
    for m in _RUN.finditer(text):
        a, b = m.span()
        if a > 1 and text[a - 1] in "'’" and text[a - 2] in "dD" and not (a > 2 and text[a - 3].isalnum()):
            a -= 2
        yield a, b


_TERM = re.compile(r"[^\W\d_]{2,}")


_ELEMENT = re.compile(rf"(?P<part>{_PART})(?={_S})|(?P<initial>[A-ZÀ-Þ]\.)|(?P<word>(?:[dD]['’])?[A-ZÀ-Þ][^ \xa0]*)")
_PART_BEFORE = re.compile(rf"(?<![\w'’-])(?:{_PART}){_S}+\Z")
_SENTENCE_ENDS = ("", ".", "!", "?", ":", ";", ")")
_GIVEN = re.compile(rf",{_S}+{_WORD}(?:{_S}+[A-ZÀ-Þ]\.)?(?!{_S}+[A-ZÀ-Þ])")
#: A name has no more words than this.
NAME_WORDS = 8


def name_ends(text: str, a: int, b: int) -> list[tuple[int, int, list[str], bool]]:
    """Where in a run of capitalised words a name may begin that ends with the run, the earliest first: (place, words, terms,
    doubtful).

    A name has two words to NAME_WORDS, particles apart; one is more than an initial. It begins with no common word; where a
    particle stands first, it may begin before or behind it. Doubtful is what only a context can tell for a name: "M.", which
    may stand for Monsieur.
    """
    elements = [(a + m.start(), m.lastgroup, m[0]) for m in _ELEMENT.finditer(text[a:b])]
    words = [e for e in elements if e[1] != "part"]
    if len(words) > NAME_WORDS:
        elements = [e for e in elements if e[0] >= words[-NAME_WORDS][0]]
    elif before := _PART_BEFORE.search(text, max(0, a - 9), a):
        elements.insert(0, (before.start(), "part", before[0].strip()))
    out, many = [], sum(e[1] != "part" for e in elements)
    for k, (at, kind, word) in enumerate(elements):
        rest = many
        many -= kind != "part"
        if rest < 2:
            break
        if kind == "word" and word.lower() in COMMON or kind == "part" and k + 1 < len(elements) and elements[k + 1][1] == "part":
            continue
        if word == "M." and (rest > 2 or text[max(0, at - 9) : at].rstrip()[-1:] in _SENTENCE_ENDS):
            continue
        held = terms(text[at:b])
        if held:
            out.append((at, rest, held, word == "M."))
    return out


_PART_INSIDE = re.compile(rf"{_S}{_PART}{_S}")


def begins_sentence(text: str, a: int, b: int) -> bool:
    """Whether a passage stands at the beginning of a sentence and is no noun with a name behind it ("Gutachten von ...")."""
    return text[max(0, a - 9) : a].rstrip()[-1:] in _SENTENCE_ENDS and not _PART_INSIDE.search(text, a, b)


def family_first(text: str, a: int, b: int) -> tuple[int, list[tuple[int, int, list[str], bool]]] | None:
    """The end of a given name that follows a run behind a comma, and where the family name before it may begin; always
    doubtful, for lists of words look alike."""
    given = _GIVEN.match(text, b)
    if not given:
        return None
    elements = [(a + m.start(), m.lastgroup, m[0]) for m in _ELEMENT.finditer(text[a:b])]
    if not elements or elements[-1][1] != "word":
        return None
    starts = [elements[-1][0]]
    if len(elements) > 1 and elements[-2][1] == "part":
        starts.insert(0, elements[-2][0])
    elif len(elements) == 1 and (before := _PART_BEFORE.search(text, max(0, a - 9), a)):
        starts.insert(0, before.start())
    return given.end(), [(at, 2, terms(text[at : given.end()]), True) for at in starts]


def context(text: str, a: int, b: int) -> tuple[str, str]:
    """The two words before and after a passage, in small letters and with digits as 0."""
    left, right = text[max(0, a - 48) : a].lower().split()[-2:], text[b : b + 48].lower().split()[:2]
    return _DIGIT.sub("0", " ".join(left)), _DIGIT.sub("0", " ".join(right))


_DIGIT = re.compile(r"\d")


def terms(phrase: str) -> list[str]:
    """The words of a phrase that may reveal a person, in small letters; particles and initials reveal nothing."""
    return [w for w in map(str.lower, _TERM.findall(phrase)) if w not in PARTICLES]


PARTICLES = frozenset("de di da del van der von zu la le".split())

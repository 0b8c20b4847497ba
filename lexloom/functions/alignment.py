"""Alignment of acronyms with the words they stand for (ALN). Plain Python, called from Arrow UDFs.

A phrase is a stream of letters, each owned by a word. An acronym is aligned
if its letters are an ordered part of the stream. Every search is one dynamic
programme over the stream: for each number of matched letters, the start of
the latest alignment that ends here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

# Words that lend no capital, and words kept between others.
STOP = frozenset("of and the for to in on with a an at by from as per via vs & de la le du des del da di von und".split())
BRIDGES = frozenset("of and for to in on with & per de la le du des del da di von und".split())
EDGE_MARKS = ".,;:!?()[]{}«»“”‘’\"'"
#: Digits that stand for a word in front.
NUMBER_WORDS = {"1": ("first", "1st", "one"), "2": ("second", "2nd", "two"), "3": ("third", "3rd", "three"), "4": ("fourth", "4th", "four"), "5": ("fifth", "5th", "five"), "6": ("sixth", "6th", "six")}
# Compounds written as one word, by their parts.
COMPOUNDS = {
    "websocket": ("Web", "Socket"),
    "middleware": ("Middle", "Ware"),
    "firmware": ("Firm", "Ware"),
    "hardware": ("Hard", "Ware"),
    "software": ("Soft", "Ware"),
    "hostname": ("Host", "Name"),
    "password": ("Pass", "Word"),
    "database": ("Data", "Base"),
    "typescript": ("Type", "Script"),
    "powershell": ("Power", "Shell"),
    "bitbucket": ("Bit", "Bucket"),
    "gitlab": ("Git", "Lab"),
    "github": ("Git", "Hub"),
    "postgresql": ("Postgres", "SQL"),
    "mysql": ("My", "SQL"),
    "mssql": ("MS", "SQL"),
    "newline": ("New", "Line"),
    "filepath": ("File", "Path"),
    "filename": ("File", "Name"),
    "checksum": ("Check", "Sum"),
    "hypertext": ("Hyper", "text"),
}

_WORD = re.compile(r"\S+")
_PARTS = re.compile(r"[-‐‑/.&–]+")
_HUMPS = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass(frozen=True)
class Word:
    text: str
    start: int
    end: int

    @property
    def is_stop(self) -> bool:
        return self.text.lower() in STOP

    @property
    def leads_with_digit(self) -> bool:
        return self.text[:1].isdigit()


@dataclass(frozen=True)
class Window:
    """First and last word of an alignment, and the words that lend letters."""

    first: int
    last: int
    hits: frozenset[int]


class Phrase(list):
    """The words of a text, with their streams once they are asked for; many acronyms are tried on one phrase."""

    def __init__(self) -> None:
        super().__init__()
        self.streams: dict[tuple[bool, bool], list[tuple[str, int]]] = {}
        self.lent: set[str] | None = None


@lru_cache(512)
def words(text: str) -> Phrase:
    """White-space words without the marks at their edges. The same list for the same text: not to be changed."""
    out = Phrase()
    for m in _WORD.finditer(text):
        raw = m.group()
        bare = raw.strip(EDGE_MARKS)
        if bare:
            a = m.start() + raw.index(bare)
            out.append(Word(bare, a, a + len(bare)))
    return out


def split_compound(word: str) -> list[str]:
    """TXT-18: parts at connecting marks, known compounds, and humps of mixed case; words with digits stay whole."""
    out: list[str] = []
    for part in filter(None, _PARTS.split(word)):
        if part.lower() in COMPOUNDS:
            out += COMPOUNDS[part.lower()]
        elif any(c.isdigit() for c in part) or part.isupper() or part.islower() or part.istitle():
            out.append(part)
        else:
            out += _HUMPS.findall(part) or [part]
    return out


def signature(acronym: str) -> str:
    """ALN-02: a mixed-case name by its capitals and humps: LaTeX as LTX, eBay as EB."""
    out = []
    for hump in _HUMPS.findall("".join(c for c in acronym if c.isalnum())):
        out += hump if hump.isupper() and len(hump) > 1 else hump[0].upper()
    return "".join(out) or acronym


def stream(phrase: list[Word], split: bool, spell_capitals: bool) -> Iterator[tuple[str, int]]:
    """ALN-01: letters with the number of their word; upper-case words may be spelt out."""
    for i, w in enumerate(phrase):
        bare = "".join(c for c in w.text if c.isalnum())
        if spell_capitals and len(bare) > 1 and bare.isupper():
            for c in bare:
                yield c, i
            continue
        for part in split_compound(w.text) if split else [w.text]:
            lead = next((c for c in part if c.isalnum()), None)
            if lead:
                yield lead.upper(), i


def _streamed(phrase: list[Word], split: bool, spell_capitals: bool) -> list[tuple[str, int]]:
    if not isinstance(phrase, Phrase):
        return list(stream(phrase, split, spell_capitals))
    if (split, spell_capitals) not in phrase.streams:
        phrase.streams[split, spell_capitals] = list(stream(phrase, split, spell_capitals))
    return phrase.streams[split, spell_capitals]


def _lent(phrase: list[Word]) -> set[str]:
    """The letters that words, their parts and capitals lend."""
    if isinstance(phrase, Phrase) and phrase.lent is not None:
        return phrase.lent
    lent = {c.upper() for w in phrase for c in (*w.text[:1], *re.findall(r"[A-Z]|(?<=[^A-Za-z])[a-z]", w.text))}
    lent |= {part[:1].upper() for w in phrase if w.text.lower() in COMPOUNDS for part in COMPOUNDS[w.text.lower()]}
    if isinstance(phrase, Phrase):
        phrase.lent = lent
    return lent


def targets(acronym: str, phrase: list[Word]) -> str:
    """ALN-03: digits count only where some word begins with one."""
    digits = any(w.leads_with_digit for w in phrase)
    return "".join(c for c in acronym if c.isalpha() or digits and c.isdigit())


def _fits(letter: str, word: Word, strict: bool) -> bool:
    """A capital wants a word that isn't a stop-word, a small letter a stop-word, unless leniently."""
    return not strict or word.is_stop == letter.islower()


def windows(acronym: str, phrase: list[Word], strict: bool, split: bool, spell_capitals: bool) -> list[Window]:
    """For each word that can end an alignment, the shortest one that ends there (ALN-04..06)."""
    letters = targets(acronym, phrase)
    if not letters:
        return []
    flow = _streamed(phrase, split, spell_capitals)
    rest = (c for c, _ in flow)
    if not all(c.upper() in rest for c in letters):  # no ordered part of the stream, however read
        return []
    # best[k]: positions of the alignment of the first k letters with the latest start
    best: list[tuple[int, ...] | None] = [()] + [None] * len(letters)
    owners: list[int] = []
    ends: dict[int, Window] = {}
    for at, (c, owner) in enumerate(flow):
        owners.append(owner)
        for k in range(len(letters), 0, -1):
            if c != letters[k - 1].upper() or not _fits(letters[k - 1], phrase[owner], strict):
                continue
            before = best[k - 1] if k > 1 else ()
            if before is None:
                continue
            now = (*before, at)
            if best[k] is None or now[0] >= best[k][0]:
                best[k] = now
                if k == len(letters):
                    ends[owner] = Window(owners[now[0]], owner, frozenset(owners[p] for p in now))
    return list(ends.values())


def aligned(acronym: str, phrase: list[Word]) -> Iterator[list[Window]]:
    """Alignments from the strictest reading to the most lenient."""
    itself = acronym.lower()
    own = {i for i, w in enumerate(phrase) if w.text.lower() == itself}  # it doesn't define itself
    forms = [acronym]
    if any(c.islower() for c in acronym) and any(c.isupper() for c in acronym):
        forms.append(signature(acronym))
    lent = _lent(phrase)
    for form in dict.fromkeys(forms):
        if not {c.upper() for c in targets(form, phrase)} <= lent | set("0123456789"):
            continue
        for strict in (True, False):
            found = [w for split in (False, True) for spell in (False, True) for w in windows(form, phrase, strict, split, spell)]
            found = [w for w in found if not own & set(range(w.first, w.last + 1))]
            if found:
                yield found


def to_the_end(acronym: str, phrase: list[Word], reach: int = 2) -> Window | None:
    """The window that runs to the last word and begins nearest to it: for a long form in front of "(ACR)".

    The alignment itself may end ``reach`` words earlier, as in "Transfer Protocol 2".
    """
    last = len(phrase) - 1
    for found in aligned(acronym, phrase):
        near = [w for w in found if last - w.last <= (reach if phrase[last].leads_with_digit else 0)]
        if near:
            w = max(near, key=lambda w: (w.first, w.last))
            return Window(_with_number(acronym, phrase, w.first), last, w.hits)
    return None


def shortest(acronym: str, phrase: list[Word]) -> Window | None:
    """The window of fewest words, the first of such: for a long form after the acronym."""
    for found in aligned(acronym, phrase):
        w = min(found, key=lambda w: (w.last - w.first, w.first))
        first, last = _with_number(acronym, phrase, w.first), w.last
        while last + 1 < len(phrase) and phrase[last + 1].leads_with_digit:
            last += 1
        while first > 0 and phrase[first - 1].leads_with_digit:
            first -= 1
        return Window(first, last, w.hits)
    return None


def _with_number(acronym: str, phrase: list[Word], first: int) -> int:
    """ALN-07: 3GPP takes Third, 3rd or 3 in front."""
    lead = acronym[:1]
    if first > 0 and lead.isdigit() and phrase[first - 1].text.lower() in (*NUMBER_WORDS.get(lead, ()), lead):
        return first - 1
    return first


def kept(text: str, phrase: list[Word], window: Window) -> str:
    """ALN-08: the words that lend letters, numbers, and bridges between them."""
    inside = range(window.first, window.last + 1)
    core = [i for i in inside if i in window.hits or phrase[i].leads_with_digit or i == window.first]
    chosen = [i for i in inside if i in core or core[0] < i < core[-1] and phrase[i].text.lower() in BRIDGES]
    if len(chosen) == len(inside):
        return " ".join(text[phrase[window.first].start : phrase[window.last].end].split())
    return " ".join(phrase[i].text for i in chosen)


def matches_initials(acronym: str, phrase: str) -> bool:
    """TXT-27."""
    return any(True for _ in aligned("".join(c for c in acronym.upper() if c.isalnum()), words(phrase)))


# ---- labels ----------------------------------------------------------------------

_PROPER = re.compile(r"[A-Z][\w'’-]*|[a-z][a-z0-9'’]*-[a-z0-9'’-]+")


def proper_run(text: str) -> str:
    """TXT-09: the longest run of proper or hyphenated words, linked by small words; the last of the longest; else all."""
    tokens = text.split()
    runs: list[tuple[int, int]] = []
    at = 0
    while at < len(tokens):
        if not _PROPER.match(tokens[at]):
            at += 1
            continue
        end = at + 1
        while end < len(tokens) and not tokens[end - 1][-1] in ".;:,":
            if _PROPER.match(tokens[end]):
                end += 1
            elif tokens[end].lower() in STOP and end + 1 < len(tokens) and _PROPER.match(tokens[end + 1]):
                end += 2
            else:
                break
        if any(t[:1].isupper() for t in tokens[at:end]):
            runs.append((at, end))
        at = end
    if not runs:
        return " ".join(tokens).rstrip(",.;:!?)]}»” ")
    a, b = max(runs, key=lambda r: (r[1] - r[0], r[1]))
    return " ".join(tokens[a:b]).rstrip(",.;:!?)]}»” ")


def tighten(label: str, acronym: str) -> str:
    """ALN-11: the part of a label that an acronym stands for; the label if it stands for none."""
    phrase = words(label)
    found = shortest(acronym, phrase) if phrase else None
    return kept(label, phrase, found) if found else " ".join(label.split()).rstrip(",.;:!?)]}»” ")


def clean(label: str, acronym: str, kind: str, most: int = 200) -> str | None:
    """TXT-10: a definition as it is kept, or None: ``inline`` ones by their proper run, all by their acronym.

    Definitions by a cue (``inline``, ``inline_before``) have two words at least.
    """
    by_cue = kind in ("inline", "inline_before")
    base = " ".join(label.split())
    if by_cue and len(base) > most:
        return None
    if kind == "inline":
        base = proper_run(base)
    elif kind == "inline_before":
        base = re.sub(r"^(?:the|an|a)\s+", "", base, flags=re.IGNORECASE)
    out = tighten(base, acronym)
    if not any(c.isalpha() for c in out) or len(out) > most or by_cue and len(out.split()) < 2:
        return None
    return out


def context(text: str, start: int, end: int, least: int = 80, most: int = 320) -> tuple[int, int]:
    """T2-02: the sentence around a span, with its neighbours if it is short, at most ``most`` characters around the span."""
    ends = [0, *(m.end() for m in re.finditer(r"[.!?;\n]", text)), len(text)]
    left = max(i for i, x in enumerate(ends) if x <= start)
    right = min((i for i, x in enumerate(ends) if x >= end and i > left), default=len(ends) - 1)
    choices = [(left, right), (max(left - 1, 0), right), (left, min(right + 1, len(ends) - 1)), (max(left - 1, 0), min(right + 1, len(ends) - 1))]
    sizes = [(ends[b] - ends[a], k) for k, (a, b) in enumerate(choices)]
    if sizes[0][0] < least:
        long = [x for x in sizes if x[0] >= least]
        left, right = choices[(min(long) if long else max(sizes, key=lambda x: (x[0], -x[1])))[1]]
    a, b = ends[left], ends[right]
    if b - a > most:
        a, b = max(0, start - most // 2), min(len(text), end + most // 2)
    return a, b

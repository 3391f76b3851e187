"""Sentence units of texts in many languages and scripts, by document-centred disambiguation.

Whether a full stop after ``Co`` or ``Inc`` ends a sentence depends on what ``Co`` is and on what the
next word is. Both are read off places where they are unambiguous. A word whose stop is followed by a
small letter elsewhere in the document is an abbreviation, one that the document has without a stop is
none; a capitalised word that the document also has in the middle of sentences is a name, one that it
also has in small letters is a common word, so that its capital marks a beginning. Where the document
is silent on a word, a short list of usual abbreviations speaks, and for all other words the same
counts over the whole corpus. A known abbreviation, too, leaves it to the next word whether the
sentence ends, unless it stands before what it belongs to: a name, or a number.

Scripts have their own rules: their own terminators, no case to look at (a quotation then ends the
sentence if a colon introduces it), no spaces, or, in Thai, spaces instead of marks.

Scale: one pass counts words over all documents; the counts are aggregated by Spark. The most
frequent words, as many as a constant, are broadcast; if there are more, the others are handed to the
texts that may ask for them by a join (see :func:`corpus_evidence`), and only then are texts shuffled.
No verdict depends on how large the corpus is, only on the proportions in it. A second pass cuts each
document by itself, in time proportional to its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import ChainMap, Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexmill.operators.batches import by_bytes
from codexmill.operators.workspace import written

# Usual abbreviations, in small letters and without their last stop.
#: They stand before a name or a text that they belong to.
BEFORE_NAMES = frozenset(
    """mr mrs ms dr prof st rev hon gen col capt lt sgt gov sen rep pres messrs mt ft
    reg regs stat pub cf e.g i.e viz vs v ca approx
    sr sra srta dra d.ª dña p.ej ee
    m mm mme mlle me env éd
    hr fr frl bzw z d.h u.a z.b bspw str vgl s.o s.u hrsg jh evtl ggf inkl zzgl
    डॉ श्री पं प्रो सं क्र
    د أ م ص""".split()
)
#: They stand before a number or a letter.
BEFORE_NUMBERS = frozenset(
    """no nos art arts sec secs ch chs cl cls ex exh fig figs vol vols p pp par para paras pt
    jan feb mar apr jun jul aug sep sept oct nov dec
    núm núms pág págs cap ej al chap n° ann abs nr bd ziff""".split()
)
LEADING = BEFORE_NAMES | BEFORE_NUMBERS
#: They may also be the last word of a sentence.
TRAILING = frozenset("inc co corp ltd llc bros etc esq jr sr. ph.d m.d a.m p.m u.s u.k u.n u.s.c u.s.a c.f.r uu usw usf cía s.a ed eds et.al dept univ assn".split())
#: Months that follow an ordinal number in German.
GERMAN_MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())
#: Japanese particles that go on after a quotation.
PARTICLES = "とがはをにのでもやへか"

_OPEN = "\"“„‟«‹「『【〈《（([｛{‘‚"
_CLOSE = "\"”“»›」』】〉》）)]｝}’"
_PAIR = {"“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "「": "」", "『": "』", "【": "】", "〈": "〉", "《": "》", "（": "）", "(": ")", "[": "]", '"': '"'}
_MARKS = ".!?…‼⁇⁈⁉。．！？｡।॥؟۔።։။៕"
_WIDE = "。．！？｡"  # full in themselves: no space follows them
_GAP = " \u00a0\u202f"  # may stand before a closing guillemet
_MARK = re.compile(f"(?:\\.(?!\\d)|[{_MARKS[1:]}])+(?:[{re.escape(_CLOSE)}]|[{_GAP}](?=»))*")
_LINE_END = r"(?:\r\n|[\n\r\x85\u2028])"
_BLANK_LINE = re.compile(rf"{_LINE_END}[^\S\n\r\x85\u2028]*{_LINE_END}\s*|\u2029\s*")
_QUOTE = re.compile("[“”„«»‹›「」『』【】〈〉《》（）()\\[\\]\"]")
_NEXT = re.compile(r"[^\W\d_]+")
_ENUMERATOR = re.compile(r"(?:[(（][0-9A-Za-z]{1,4}[)）]|[0-9]{1,3}(?:\.[0-9]{1,3})*[.)]|[A-Za-z][.)]|[ivxlcIVXLC]{1,6}[.)])(?=\s)")
_LIST = re.compile(r"[:：][^\S\n\r]*(?:\r\n|\n|\r)\s*(?:[(（]?[0-9A-Za-z]{1,4}[.)）]|[-–•*])\s")
_ITEM = re.compile(r"[^\S\n\r]*(?:\r\n|\n|\r)\s*(?:[(（](?:[0-9]{1,3}|[A-Za-z]|[ivxlc]{1,5})[)）]|(?:[0-9]{1,3}|[A-Za-z]|[ivxlc]{1,5})[.)]|[-–•*])\s")
_HEADING = re.compile(r"[§#]{0,2}\s*(?:[^\W\d_]+\.?\s+)?(?:[0-9]+(?:[.\-][0-9]+)*|[IVXLC]+|[A-Z])\.(?=\s)")
_THAI = re.compile("[฀-๿]")
_THAI_SPACE = re.compile(r"(?<=[฀-๿])(?<!\d)[^\S\n\r]+(?=[^\d\s])|(?<=[^\d\s.])[^\S\n\r]+(?=[฀-๿])(?!\d)")
_VISIBLE = re.compile(r"[^\s\x00-\x1f\x7f-\x9f\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")

_SMALL, _LARGE = "a-zß-öø-ÿα-ωа-яё", "A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ"
_WORD = re.compile(r"[^\W\d_]+(?:\.[^\W\d_]+)*\.?")
_INNER = re.compile(rf"\.(?:[,;:]|[ \n][ \n]?[{_SMALL}](?![{_LARGE}]))")
_FOLLOWING = re.compile(rf"[\s{re.escape(_OPEN)}¿¡§—–\-•*]*([^\W\d_]+)")
_SPACED = re.compile(r"(?<=\s)[^\W\d_]+")
#: A number in letters, or what has a number in it.
_DESIGNATOR = re.compile(r"(?:[IVXLCDM]+|[A-Z])(?![^\W_])|[A-Z]{1,4}[-–.]?[0-9]")
#: A longer run of characters without white space is no word.
LONGEST_WORD = 256
#: So many words of a document are looked up one by one before all of them are counted at once.
LOOK_UPS = 8
_MIDDLE = re.compile(rf"[{_LARGE}](?:(?<=[{_SMALL}][ \n].)|(?<=[{_SMALL}],[ \n].))[{_SMALL}'’]+")


def inner_stops(text: str) -> Counter:
    """Words (small letters) whose stop is followed by what can't begin a sentence."""
    out: Counter = Counter()
    for m in _INNER.finditer(text):
        if w := last_word(text, m.start()):
            out[w.lower()] += 1
    return out


def last_word(text: str, end: int) -> str:
    """The letters before a place, with the stops between them."""
    at = end
    while at and (text[at - 1].isalpha() or 1 < at < end and text[at - 1] == "." and text[at - 2].isalpha()):
        at -= 1
    return text[at:end]


@dataclass
class Evidence:
    """Counts of unambiguous occurrences, by word."""

    #: See :func:`inner_stops`.
    inner: Counter = field(default_factory=Counter)
    #: Word as it stands, with the stop that may follow it.
    word: Counter = field(default_factory=Counter)
    #: Capitalised word: in the middle of a sentence.
    name: Counter = field(default_factory=Counter)

    def add(self, text: str) -> None:
        self.word.update(_WORD.findall(text))
        self.inner.update(inner_stops(text))
        self.name.update(_MIDDLE.findall(text))


class Verdicts:
    """What a document and the corpus say about a word. Each is asked for only what is in doubt."""

    def __init__(self, corpus: Mapping[str, tuple[int, int, int]]):
        self.corpus = corpus
        self.begin("")

    def begin(self, text: str) -> None:
        self.text, self.inner, self.known, self.own, self.middle, self.looked_up = text, None, {}, None, None, 0

    def _bare(self, word: str) -> int:
        """How often the document has a word between spaces or before a comma."""
        if self.own is None:
            self.own = Counter(self.text.split())
        return self.own[word] + self.own[f"{word},"]

    def _named(self, word: str) -> int:
        """How often the document has a capitalised word in the middle of a sentence."""
        if self.middle is not None:
            return self.middle[word]
        if self.looked_up == LOOK_UPS:
            places = ((m.start(), m.end(), m[0]) for m in _SPACED.finditer(self.text))
            self.middle = Counter(w for at, end, w in places if self._in_middle(w, at, end))
            return self.middle[word]
        self.looked_up += 1
        t, n, at = self.text, 0, self.text.find(word)
        while at >= 0:
            end = at + len(word)
            n += self._in_middle(word, at, end)
            at = t.find(word, end)
        return n

    def _in_middle(self, word: str, at: int, end: int) -> bool:
        t = self.text
        before, after = t[at - 2 : at] if at > 1 else "", t[end : end + 1]
        return len(before) == 2 and before[1].isspace() and (before[0].islower() or before[0] == ",") and not (after.isalpha() or after == "." and word.lower() in LEADING)

    def shown(self, word: str) -> bool | None:
        """Whether the document shows that the stop after a word (small letters) belongs to it, or that
        it doesn't; None if the document says nothing."""
        if self.inner is None:
            self.inner = inner_stops(self.text)
        here, own = self.inner[word], self._bare(word)
        return None if here == own else here > own

    def abbreviation(self, word: str) -> bool:
        """Whether the stop after a word (small letters) belongs to the word."""
        found = self.known.get(word)
        if found is None:
            found = self.known[word] = self._abbreviation(word)
        return found

    def _abbreviation(self, word: str) -> bool:
        if word.isdigit():
            return False
        shown = self.shown(word)
        if shown is not None:
            return shown
        if word in LEADING or word in TRAILING:
            return True
        inner, bare, _ = self.corpus.get(word, (0, 0, 0))
        return inner > 2 * bare

    def begins(self, word: str) -> bool:
        """Whether a capitalised word is capitalised because a sentence begins."""
        found = self.known.get((word,))
        if found is None:
            found = self.known[(word,)] = self._begins(word)
        return found

    def _begins(self, word: str) -> bool:
        small = word.lower()
        name, common = self._named(word), self._bare(small)
        if name != common or small in LEADING:  # the corpus counts its abbreviated form with it
            return common >= name
        _, bare, _ = self.corpus.get(small, (0, 0, 0))
        _, _, named = self.corpus.get(word, (0, 0, 0))
        return bare >= named


def _spans(block: str) -> list[tuple[int, int]]:
    """Places (open, close) of the outermost quotations and brackets of a block that are closed. A mark
    that is never closed doesn't hide what is closed after it."""
    closed: list[tuple[int, int]] = []
    stack: list[tuple[int, str]] = []
    for m in _QUOTE.finditer(block):
        c = m[0]
        if stack and c in stack[-1][1]:
            closed.append((stack.pop()[0], m.start()))
        elif c in _PAIR and not (c == "»" and _closes_nothing(block, m.start())):
            stack.append((m.start(), _PAIR[c]))
    out: list[tuple[int, int]] = []
    for a, b in sorted(closed):
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


def _closes_nothing(block: str, at: int) -> bool:
    return at > 0 and not block[at - 1].isspace()


def _caseless(ch: str) -> bool:
    return ch.isalpha() and not ch.isupper() and not ch.islower()


def cut_block(block: str, verdicts: Verdicts) -> list[tuple[int, int]]:
    """The units of a block of text between blank lines, as places in it."""
    n = len(block)
    spans = _spans(block)
    cuts, start, si = [], 0, 0
    lists = [m.start() for m in _LIST.finditer(block)] if ":" in block or "：" in block else []
    items: dict[int, list[re.Match]] = {}
    labels = {m.end() - 2 for m in _ITEM.finditer(block)} if lists else ()
    m = _HEADING.match(block)
    skip_to = m.end() if m else 0
    if not skip_to and (m := _ENUMERATOR.match(block)):
        skip_to = m.end()
    danda = "।" in block
    for m in _MARK.finditer(block):
        at, end = m.start(), m.end()
        if at < skip_to:
            continue
        while si < len(spans) and spans[si][1] < at:
            si += 1
        inside = si < len(spans) and spans[si][0] < at
        if inside and spans[si][1] >= end:
            continue  # within a quotation or bracket that goes on
        if end >= n:
            break
        marks, ch = m[0], block[end]
        if end > at + 1:
            marks = marks.rstrip(_CLOSE + _GAP)
        elif marks == "." and ch == " " and block[end + 1].islower() and not block[end + 2 : end + 3].isupper():
            continue
        space = ch.isspace()
        if not space and not (ch.isalpha() or ch in _OPEN or ch in "¿¡§—–-•" or (ch.isdigit() and marks[-1] in _WIDE)):
            continue
        if lists and (at in labels and _opened(lists, start, at) >= 0 or _goes_on(block, end, lists, items, start, at)):
            continue
        if not _ends(block, start, at, end, marks, ch, space, spans[si] if inside else None, danda, verdicts):
            continue
        cuts.append((start, end))
        start = end
        while start < n and block[start].isspace():
            start += 1
        if start + 1 < n and (not block[start + 1].islower() or block[start] in "ivxlc") and (e := _ENUMERATOR.match(block, start)):
            skip_to = e.end()
    if start < n:
        cuts.append((start, n))
    return cuts


def _opened(lists: list[int], start: int, at: int) -> int:
    """The last colon before a place that opens a list in the unit from ``start`` on, or -1."""
    i = bisect_left(lists, at)
    return lists[i - 1] if i and lists[i - 1] >= start else -1


def _goes_on(block: str, end: int, lists: list[int], seen: dict[int, list[re.Match]], start: int, at: int) -> bool:
    """Whether the next line has the next item of a list that a colon opened in this unit: the label
    that follows the last one's, and a text that begins as the first item's does. ``seen`` keeps the
    first and last item of a list, so that each is looked for once."""
    opened = _opened(lists, start, at)
    following = _ITEM.match(block, end) if opened >= 0 else None
    if following is None:
        return False
    ends = seen.get(opened, [])
    for m in _ITEM.finditer(block, ends[-1].end() if ends else opened + 1, at):
        ends = [ends[0] if ends else m, m]
    if not ends:
        return False
    seen[opened] = ends
    items = ends
    last, label = items[-1][0].strip(" ()（）.)\r\n\t"), following[0].strip(" ()（）.)\r\n\t")
    if label.isdigit() and last.isdigit():
        fits = int(label) == int(last) + 1
    elif len(label) == len(last) == 1 and label.isalpha():
        fits = ord(label) == ord(last) + 1
    else:
        fits = label == last or {*label, *last} <= {*"ivxlc"}
    return fits and _capital(block, following.end()) == _capital(block, items[0].end())


def _word_before(block: str, start: int, at: int) -> str:
    """What stands before a mark without white space, opening marks or apostrophes."""
    found = block[max(start, at - 24) : at]
    if not found or found[-1].isspace():
        return ""
    parts = found.split()
    if len(parts) == 1 and not found[0].isspace():
        parts = block[max(start, at - LONGEST_WORD) : at].split()
    found = parts[-1].lstrip(_OPEN)
    for c in "'’(-–/":
        if c in found:
            found = found[found.rfind(c) + 1 :]
    return found


def _ends(block: str, start: int, at: int, end: int, marks: str, ch: str, space: bool, span: tuple[int, int] | None, danda: bool, verdicts: Verdicts) -> bool:
    """Whether the mark at ``at``, which with what closes after it ends at ``end``, ends its sentence."""
    n, nxt = len(block), end
    if marks == "." and ch == " " and end == at + 1 and span is None and block[end + 1].isupper():
        word = _word_before(block, start, at)
        if len(word) > 1 and word.isalpha():
            word = word.lower()
            if word in LEADING:
                return _leading_ends(block, word, end + 1, verdicts)
            initial = block[end + 2 : end + 3] == "."
            return not verdicts.abbreviation(word) or initial or _is_beginning(block, end + 1, verdicts)
    elif span is None and marks in _WIDE:
        return True
    while nxt < n and (block[nxt].isspace() or block[nxt] in _OPEN or block[nxt] in "¿¡§—–-•*"):
        nxt += 1
    if nxt >= n:
        return True
    first = block[nxt]
    quoted = span is not None
    if first.isdigit():
        item = _ENUMERATOR.match(block, nxt)
    else:
        item = _ENUMERATOR.match(block, nxt - 1) if block[nxt - 1] in "(（" else _ENUMERATOR.match(block, nxt)
    opens_item = item is not None and item.end() < n and _capital(block, item.end())
    wide = marks[-1] in _WIDE
    caseless = _caseless(first)
    if wide or caseless:
        if marks == "." and not wide:
            word = _word_before(block, start, at)
            if not word:
                return True
            if danda and not word.isascii() or word.lower() in LEADING and verdicts.shown(word.lower()) is not False or word.isdigit() and not space:
                return False
            if not space and word.isascii():
                return False
            if len(word) == 1 and word.isalpha() or len(word) <= 4 and _THAI.match(word):
                return False
            if verdicts.abbreviation(word.lower()):
                return False
        if quoted:
            return _quotation_ends(block, start, span[0], nxt, first)
        return True
    capital = first.isupper() or (first.islower() and nxt + 1 < n and block[nxt + 1].isupper())
    if marks[-1] in "।॥؟۔":
        return True
    if marks[-1] != ".":
        if marks[-1] == "…" or marks.endswith("..."):
            return (capital and (not first.isupper() or _is_beginning(block, nxt, verdicts))) or opens_item or (capital and block[nxt - 1] in "(“")
        return capital or opens_item or (first.isdigit() and space)
    if len(marks) >= 3 and set(marks) == {"."}:
        return capital or opens_item
    closed = end > at + 1
    original = _word_before(block, start, at).strip(".")
    word = original.lower()
    if not space and not closed:  # no space: only between a whole word and a capitalised one
        if not (capital and len(word) > 1 and "." not in word):
            return block[end] in "“«„(" and capital and len(word) > 1
        shouted = original.isupper() and len(original) > 2 and (m := _NEXT.match(block, nxt)) and len(m[0]) > 2
        if word[-1].isdigit() or not (shouted or first.islower() or nxt + 1 < n and (block[nxt + 1].islower() or block[nxt + 1] in ".'’ ")):
            return False
        return not verdicts.abbreviation(word)
    if not (capital or opens_item or first.isdigit()):
        return False
    if not word:
        return capital or opens_item
    if word.isdigit() and capital and len(word) <= 2 and (m := _NEXT.match(block, nxt)) and m[0] in GERMAN_MONTHS:
        return False
    if closed and block[end - 1] in "”“»」\"" and capital:
        return True
    if first.isdigit() and not opens_item:
        return not (word in LEADING or word in TRAILING or verdicts.abbreviation(word) or len(word) == 1)
    if len(original) == 1 and original.isupper():
        # An initial, unless the next word begins a sentence and nothing before is a name's part.
        if not first.isupper():
            return True
        m = _NEXT.match(block, nxt)
        if m and len(m[0]) == 1 and block[nxt + 1 : nxt + 2] == ".":
            return False
        return bool(m) and not _initial_before(block, start, at) and verdicts.begins(m[0]) and verdicts.corpus.get(m[0].lower(), (0, 0, 0))[1] > 0
    if word in LEADING:
        return _leading_ends(block, word, nxt, verdicts)
    if not verdicts.abbreviation(word) and not ("." in word and all(len(p) == 1 for p in word.split("."))):
        return True
    if opens_item:
        return True
    return capital and (first.islower() or _is_beginning(block, nxt, verdicts))


def _leading_ends(block: str, word: str, nxt: int, verdicts: Verdicts) -> bool:
    """Whether the stop of an abbreviation that stands before what it belongs to ends the sentence: if
    the document shows that it is a word, or if what follows can't belong to it, and a sentence may begin."""
    plain = verdicts.shown(word) is False
    if word in BEFORE_NUMBERS:
        m = _DESIGNATOR.match(block, nxt)
        if m is not None and not (plain and len(m[0]) == 1 and block[m.end() : m.end() + 1] == " " and block[m.end() + 1 : m.end() + 2].islower()):
            return False
    elif not plain:
        return False
    return block[nxt].isupper() and _is_beginning(block, nxt, verdicts)


def _initial_before(block: str, start: int, at: int) -> bool:
    """Whether the letter before ``at`` follows another initial, or opens the unit."""
    left = block[start : at - 1].rstrip()
    return not left or left[-1] == "." and len(left) > 1 and left[-2].isupper()


def _capital(block: str, at: int) -> bool:
    n = len(block)
    while at < n and (block[at].isspace() or block[at] in _OPEN):
        at += 1
    return at < n and (block[at].isupper() or _caseless(block[at]))


def _is_beginning(block: str, at: int, verdicts: Verdicts) -> bool:
    m = _NEXT.match(block, at)
    if m is None or len(m[0]) == 1 and block[m.end() : m.end() + 1].isspace() and block[m.end() + 1 : m.end() + 2].islower():
        return True  # a word of one letter, not a letter that names something
    return verdicts.begins(m[0])


def _quotation_ends(block: str, start: int, opened: int, nxt: int, first: str) -> bool:
    """Without case: a quotation ends its sentence if a colon introduces it and no particle follows."""
    lead = block[start:opened].rstrip()
    if not lead:
        return block[opened] in "([（【"
    if first in PARTICLES:
        return False
    return lead[-1] in ":：" or block[opened] in "([（"


def _thai_cuts(block: str, units: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The units cut at spaces next to Thai letters; spaces next to numbers or stops never are."""
    out = []
    for a, b in units:
        at = a
        for m in _THAI_SPACE.finditer(block, a, b):
            out.append((at, m.start()))
            at = m.end()
        out.append((at, b))
    return out


def sentence_units(text: str, verdicts: Verdicts) -> list[tuple[int, int]]:
    """(start, end) of each unit of a text, in code points, the end exclusive."""
    verdicts.begin(text)
    out, at, thai = [], 0, _THAI.search(text) is not None
    ends = [(m.start(), m.end()) for m in _BLANK_LINE.finditer(text)] + [(len(text), len(text))]
    for stop, after in ends:
        block = text[at:stop]
        bare = block.lstrip()
        left, block = len(block) - len(bare), bare.rstrip()
        if block and _VISIBLE.search(block):
            units = cut_block(block, verdicts)
            if thai:
                units = _thai_cuts(block, units)
            for a, b in units:
                while b > a and block[b - 1].isspace():
                    b -= 1
                if block[a].isalnum() or _VISIBLE.search(block, a, b):
                    out.append((at + left + a, at + left + b))
        at = after
    return out


def questions(text: str, known: Mapping) -> set[str]:
    """All words of a text for which its cuts may ask the corpus, but those in ``known``: what stands
    before a mark, whole or from one of its inner stops on, and the next word, as it is and in small letters."""
    out = set()
    for m in _MARK.finditer(text):
        if w := last_word(text, m.start()):
            parts = w.lower().split(".")
            out.update(".".join(parts[i:]) for i in range(len(parts)))
        if f := _FOLLOWING.match(text, m.end()):
            out |= {f[1], f[1].lower()}
    return out - known.keys()


def corpus_evidence(df: DataFrame, text: str, most_words: int = 100_000) -> tuple[dict[str, tuple[int, int, int]], DataFrame | None]:
    """Counts over all texts: (inner, bare, name) of the ``most_words`` most frequent words, and the
    table of all other words, or None if there are none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Evidence()

        def flush() -> pa.RecordBatch:
            words = {*e.inner, *e.word, *e.name}
            rows = [(w, e.inner[w], e.word[w], e.name[w]) for w in words if w[-1] != "."]
            for c in (e.inner, e.word, e.name):
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)]], names=["word", "inner_n", "bare_n", "name_n"])

        for batch in by_bytes(batches, 0):
            for t in batch.column(0).to_pylist():
                if t:
                    e.add(t)
            if len(e.word) > 500_000:
                yield flush()
        yield flush()

    counted = written(
        df.select(F.col(text).cast("string"))
        .mapInArrow(count, "word string, inner_n long, bare_n long, name_n long")
        .groupBy("word")
        .agg(F.sum("inner_n").alias("inner_n"), F.sum("bare_n").alias("bare_n"), F.sum("name_n").alias("name_n")),
        "sentence-words",
    )
    n = F.col("inner_n") + F.col("bare_n") + F.col("name_n")
    often = counted.orderBy(n.desc(), "word").limit(most_words + 1).collect()
    hot = {r["word"]: (r["inner_n"], r["bare_n"], r["name_n"]) for r in often[:most_words]}
    if len(often) <= most_words:
        return hot, None
    last = often[most_words]
    least = last["inner_n"] + last["bare_n"] + last["name_n"]
    return hot, counted.where((n < least) | (n == least) & (F.col("word") >= last["word"]))


def _asked(df: DataFrame, tail: DataFrame, hot) -> DataFrame:
    """(__key, __evidence) of each text, by its digest, that may ask for words of ``tail``: their counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            take, words = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = questions(t, hot.value) if t else ()
                take += [i] * len(found)
                words += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(words, pa.string())], names=["__key", "word"])

    asked = df.select("__key", "__text").mapInArrow(ask, "__key binary, word string").distinct()
    return asked.join(tail, "word").groupBy("__key").agg(F.collect_list(F.struct("word", "inner_n", "bare_n", "name_n")).alias("__evidence"))


def split_sentences(df: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, most_words: int = 100_000) -> DataFrame:
    """(doc_id, start_char, end_char[, sentence]): every sentence unit of every text.

    Defined cases: null and empty texts, and texts without a visible character, have no units. Ids
    are kept as they are, null or repeated. A text without any mark is one unit per block between
    blank lines, however long. Languages named in other columns are not relied on: every rule
    looks at the characters. Other columns are never read. Empty input gives an empty table.
    ``most_words`` says how many words are broadcast; the result doesn't depend on it.
    """
    spark = df.sparkSession
    hot, tail = corpus_evidence(df, text, most_words)
    corpus = spark.sparkContext.broadcast(hot)
    id_type = df.schema[doc_id].dataType
    schema = T.StructType([T.StructField(doc_id, id_type), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType())])
    if with_text:
        schema.add("sentence", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdicts = Verdicts(corpus.value)
        for batch in by_bytes(batches, 1):
            take, starts, ends, parts = [], [], [], []
            evidence = batch.column(2) if batch.num_columns > 2 else None
            for i, t in enumerate(batch.column(1).to_pylist()):
                if not t:
                    continue
                if evidence is not None:
                    rare = {e["word"]: (e["inner_n"], e["bare_n"], e["name_n"]) for e in evidence[i].as_py() or ()}
                    verdicts.corpus = ChainMap(rare, corpus.value) if rare else corpus.value
                units = sentence_units(t, verdicts)
                take += [i] * len(units)
                starts += [a for a, _ in units]
                ends += [b for _, b in units]
                if with_text:
                    parts += [t[a:b] for a, b in units]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), *([pa.array(parts, pa.string())] if with_text else [])],
                names=schema.names,
            )

    source = df.select(F.col(doc_id), F.col(text).cast("string").alias("__text"))
    if tail is not None:
        key = F.unhex(F.sha2("__text", 256)).alias("__key")
        asked = _asked(source.select(key, "__text"), tail, corpus)
        source = source.select(F.col(doc_id).alias("__id"), "__text", key).join(asked, "__key", "left").select(F.col("__id").alias(doc_id), "__text", "__evidence")
    return source.mapInArrow(run, schema)

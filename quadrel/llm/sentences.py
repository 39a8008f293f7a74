"""Sentence boundaries across languages and scripts.

A hidden-event n-gram language model: between two words there may be a hidden boundary event. A text is cut into blocks
at blank lines. What stands between two words is observed: a closing mark with the word before it, closing quotes or
brackets, a space in a script that puts none between words (Thai), or nothing but a space.

    P(event | what stands between)          how often a sentence ends there: with that word and mark, at such a quote
    P(word after | event)                   how sentences begin
    P(word after | no event, what stands)   how a sentence goes on

All three are estimated from the whole corpus without labels, for every script. Beginnings and ends of blocks are sure
events; everything else is a mixture that EM takes apart (a word that is never followed by an end of text or by a
typical opening word is an abbreviation). Rules are features only: whether a quotation opens a sentence or follows a
colon, whether dots stand at a sentence's beginning and so on name the row of the table, with a prior (PRIORS) that the
corpus' counts move. Words under a share of the corpus, and words longer than LONG, back off to their shape, so the
model's size is bounded whatever the corpus. Forward-backward over the places of a block gives each boundary's
posterior; the event at one place acts on the next through list markers and quotations that open a sentence.

A space between words alone is a place in scripts whose blocks mostly end without any mark (UNMARKED): there sentences
are not punctuated, and the words before and after decide. Where blocks end with marks such spaces are no places.

Quotations and brackets are matched first: no event lies inside. Places are found once and written, words as hashes of
64 bits; training counts them with native aggregates, deciding reads them again, without any text, in whole columns.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.runtime import Scratch

#: A word is in the model if it makes up this share of all words, and occurs at least LEAST times: at most 1/SHARE words.
SHARE = 2e-6
LEAST = 5
#: A word seen less often, and not at the beginning of a sentence, tells nothing about beginnings.
FEW = 20
#: Counts that a task gathers before it hands them on.
FLUSH = 200_000
#: Share of P(class | no event) that is spread evenly over the classes.
FLOOR = 0.01
#: Factor of a sentence of a single word between two events.
ONE_WORD = 0.3
#: A word longer than this is known by its shape only.
LONG = 24
#: A script is unpunctuated if at least this share of its blocks end without a mark.
UNMARKED = 0.5
#: P(event) at least, before anything is counted, after a word that looks like an ordinary one.
ORDINARY = 0.9
#: P(event) that each kind of place starts from, and the weight of this prior as a multiple of the row's count.
PRIORS = {
    "!": (0.98, 0.5),  # a mark of sentences
    "!9": (0.3, 0.5),  # with a digit right after it
    '"o': (0.05, 0.5),  # the end of a quotation that opened a sentence: who speaks follows
    '":': (0.98, 0.5),  # of one after a colon
    '"m': (0.9, 0.5),  # of another
    ")o": (0.95, 0.5),  # the end of a bracket that opened a sentence
    ")m": (0.05, 0.5),  # of another
    "…o": (0.01, 8.0),  # dots after the first words of a sentence: an event would make these a sentence, so words count less
    "…u": (0.6, 0.5),  # other dots before a capital or a quotation
    "_": (0.9, 0.5),  # a space in a script without spaces between words
}

_BLANK = regex.compile(r"(?>\r\n|[\n\r\x85  ])[^\S\n\r\x85  ]*+(?>(?>\r\n|[\n\r\x85  ])\s*+)+")
_SPACE = regex.compile(r"\s*")
#: Closing marks (fixed values): of sentences for sure, and those that also stand in abbreviations, numbers and pauses.
STRONG = "!?！？؟。｡।॥۔‽⁇⁈⁉።፧፨។៕။"
WEAK = ".…．‥"
_MARKS, _STRONG = frozenset(STRONG + WEAK), frozenset(STRONG)
_PLACE = regex.compile(rf"[{STRONG}{WEAK}]+|[\"“”„«»‹›「」『』（）()\[\]【】〈〉《》]|(?<=[\p{{Thai}}”\"»’)\]!?]) (?=[\p{{Thai}}“\"«‘(\[])|[‘’]")
_OPEN = {"‘": "’", "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "›": "‹", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "〈": "〉", "《": "》"}
_BRACKETS = "()（）[]【】〈〉《》"
_CLOSERS = "”’'\"»›」』)）]】"
_OPENING = "“„«‹「『(（[【\"'‘¿¡"
#: What may stand before an opening quote besides white space.
_LEAD = _OPENING + "-–—:：，、。"
_LIST = regex.compile(r"[\(（]?(?:\p{N}{1,3}(?:\.\p{N}{1,3})*|\p{L})$")
#: A list item's number, letter or dash on a new line.
_ITEM = regex.compile(r"\s*[\n\r]\s*(?:[\(（]?(?:\p{N}{1,3}(?:\.\p{N}{1,3})*|\p{L})[.)）]|[-–—•*])[^\S\n\r]")
ITEM = "<item>"
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_DIGITS = regex.compile(r"\p{N}")
_QUOTES = regex.compile("[\"“”„«»‹›「」『』（）()\\[\\]【】〈〉《》‘’]")
#: The last character that can't be part of a word before a mark.
_BREAKS = regex.compile(rf"(?r)[\s\"“„«»‹「『(（\[【”{STRONG}]")
_TOKEN = regex.compile(r"\S+")
_SHORT_TOKEN = regex.compile(rf"\S{{1,{LONG + 9}}}")
_LETTER = regex.compile(r"(?r)\p{L}")
_LETTER_AHEAD = regex.compile(r"\p{L}")
LONG_WORD = "<long>"
_CASED = regex.compile(r"[\p{Lu}\p{Ll}\p{Lt}]")

# classes of what follows a place
END, OPENS, OFTEN, SELDOM, MID, UPPER, LOWER, DIGIT, QUOTE, OTHER, CASELESS = range(11)
CLASSES = 11
#: Classes that a sentence's inside doesn't lead to; P(class | no event) of these is small and fixed.
_RARE_INSIDE = {END: 0.004, OPENS: 0.02, QUOTE: 0.02}


@lru_cache(maxsize=200_000)
def _key(token: str) -> str:
    """A token as the model knows it: without quotes and brackets before, commas and the like after; digits alike."""
    token = token.lstrip(_OPENING).rstrip(",;:!?،؛؟…" + _CLOSERS)
    if len(token) > LONG:
        return token[0] + LONG_WORD
    return _DIGITS.sub("0", token.rstrip(".") if token.endswith("..") else token)


def _word_before(block: str, at: int) -> tuple[str, int]:
    """The token that ends at a mark, and where it begins; empty in scripts without spaces."""
    low = max(0, at - LONG - 1)
    space = block.rfind(" ", low, at)
    if space >= 0 and (word := block[space + 1 : at]).isalpha() and word.isascii():
        return word, space + 1
    cut = _BREAKS.search(block, low, at)
    start = cut.end() if cut else low
    word = block[start:at]
    if not cut and at - low > LONG:
        return "" if _WIDE.match(word[-1]) else LONG_WORD, at - LONG
    if word and not word.isascii() and _WIDE.match(word[-1]):
        return "", start
    return word if word.isalpha() else _DIGITS.sub("0", word), start


def _pair(block: str, at: int, word: str) -> str:
    """A short word (г, д, A, ...) says little alone: with the token before it."""
    while at > 0 and block[at - 1] in " \xa0":
        at -= 1
    start = at
    while start > 0 and at - start <= LONG and not block[start - 1].isspace():
        start -= 1
    if at - start > LONG:
        return ""
    before = _DIGITS.sub("0", block[start:at])
    return f"{'0' if before.isdigit() else before} {word}" if before else ""


def _word_after(block: str, at: int) -> tuple[str | None, int]:
    """The token that follows a place (None at the end; two characters in scripts without spaces), and where it begins."""
    begin, size = at, len(block)
    while at < size and block[at].isspace():
        at += 1
    if at >= size:
        return None, at
    if at > begin and (block.find("\n", begin, at) >= 0 or block.find("\r", begin, at) >= 0) and _ITEM.match(block, begin):
        return ITEM, at
    start = at
    while at < size - 1 and block[at] in "¿¡":
        at += 1
    c = block[at]
    if c >= "\u3040" and _WIDE.match(c):
        return block[at : at + 2], start
    m = _SHORT_TOKEN.match(block, at)
    if m is None:
        return c, start
    if c in _OPENING and c != "'":
        return c, start
    token = m.group()
    return _key(token) or c, start


#: Kinds of shape: nothing, a number, and 18 of words by their first letter's case, length and inner full stops.
SHAPES = 20


def shape(word: str) -> int:
    """What an unknown word before a place backs off to."""
    if not word:
        return 0
    if "0" in word and not any(c.isalpha() for c in word):
        return 1
    size = min(len(word), 3) - 1
    first = next((c for c in word if c.isalpha()), "")
    case = 0 if first.isupper() else 1 if first.islower() else 2
    return 2 + case * 6 + size * 2 + ("." in word)


def ordinary(word: str) -> bool:
    """Whether a word has the length of words that are no abbreviations."""
    return len(word) > 2 and word.isalpha()


def shape_class(token: str | None) -> int:
    if token is None:
        return END
    c = token[0]
    if c in _OPENING and c != "'":
        return QUOTE
    if c.isdigit():
        return DIGIT
    if c.isupper():
        return UPPER
    if c.islower() or c in ",;:，、،；；":
        return LOWER
    return CASELESS if c.isalpha() else OTHER


class Place:
    """A place in a block where a sentence may end."""

    __slots__ = ("end", "word", "after", "next", "kind", "opened", "listed", "tight", "colon", "script", "wide", "pair", "marker")

    def __init__(self, end: int, word: str, after: str | None, following: int, kind: str):
        self.end, self.word, self.after, self.next, self.kind = end, word, after, following, kind
        self.opened: int | None = None  # where the quotation or bracket that closes here was opened
        self.listed = False  # may be the mark of a list item, if a sentence begins right before it
        self.marker = 0  # where that list item's marker begins
        self.tight = False  # no space follows
        self.colon = False
        self.script = "c"  # of the letters before, see script_of()
        self.wide = False  # a mark of a script without spaces
        self.pair = ""  # a short word before with the token before it


def _thai(block: str, at: int, step: int) -> bool:
    """Whether the next letter from here is Thai, past quotes, brackets and marks."""
    while 0 <= at < len(block):
        if block[at].isalpha():
            return "\u0e00" <= block[at] <= "\u0e7f"
        if block[at].isdigit() or block[at].isspace() and step < 0:
            return False
        if "\u0e00" <= block[at] <= "\u0e7f":
            return True
        at += step
    return False


def _script(block: str, at: int, low: int, last: str) -> str:
    """The script of the last letter before a place; `last` is that of the letters before `low`, where the place before was."""
    m = _LETTER.search(block, low, at)
    if m is None:
        return last
    return script_of(m.group())


def script_of(c: str) -> str:
    """Of a letter: c with case, o without, w wide (no spaces between words), t Thai (a space between sentences)."""
    return "c" if c.isupper() or c.islower() else "w" if _WIDE.match(c) else "t" if "\u0e00" <= c <= "\u0e7f" else "o"


def _pairs(block: str, first: bool, final: bool) -> list[tuple[int, int]]:
    """Quotations and brackets as (open, close) positions.

    Texts may be cut. In the last block a quotation without its end reaches to the text's end, whatever its length; in
    the first a quotation without its beginning, closed before any other opens, reaches from -1 on. Brackets, single
    quotes, and marks that look like neither, without a partner are ordinary text.
    """
    stack: list[tuple[int, str, str]] = []
    out: list[tuple[int, int]] = []
    quoted = False
    for m in _PLACE.finditer(block):
        c = m.group()
        if len(c) > 1 or c in STRONG or c in WEAK or c.isspace():
            continue
        at = m.start()
        before = block[at - 1] if at else " "
        after = block[at + 1] if at + 1 < len(block) else " "
        if c == "’" and (after.isalnum() or not any(s[1] == "‘" for s in stack)) or c == "‘" and before.isalnum():
            continue  # an apostrophe
        leans_right = (before.isspace() or before in _LEAD) and not after.isspace() and after not in ".,;:!?"
        hit = next((k for k in range(len(stack) - 1, -1, -1) if c in stack[k][2]), None)
        if hit is not None and c in "\"“»«" and leans_right and before in " \n" and not block[stack[hit][0] + 1 : at].strip() == "":
            # it looks like the beginning of another quotation: the open one lost its end
            hit = None
        if hit is not None:
            out.append((stack[hit][0], at))
            quoted = quoted or c not in _BRACKETS
            del stack[hit:]
        elif c in _OPEN and (c != "»" or leans_right) or c == '"' and leans_right:
            if c not in _BRACKETS:
                stack = [s for s in stack if s[1] != c]
            stack.append((at, c, _OPEN.get(c, c)))
        elif first and c not in _BRACKETS and not quoted and not any(s[1] not in _BRACKETS for s in stack):
            out.append((-1, at))
            quoted = True
    if final:
        out += [(at, len(block)) for at, c, _ in stack if c not in _BRACKETS and c != "‘"]
    return sorted(out)


def places(block: str, first: bool = True, final: bool = True, plain: str = "") -> list[Place]:
    """The places of a block, in order; `first` and `final` if it begins or ends the text, which may be cut inside a
    quotation. Spaces between words alone are places after letters of the scripts in `plain`."""
    pairs = _pairs(block, first, final) if _QUOTES.search(block) else []
    found: list[Place] = []
    k, inside = 0, []
    seen, script, size = 0, "c", len(block)
    for m in _PLACE.finditer(block):
        at, end = m.span()
        lead = block[at]
        thai = lead == " "
        if not thai and lead not in _MARKS:
            continue
        c = lead if end - at == 1 else block[at:end]
        around = []
        if pairs:
            while k < len(pairs) and pairs[k][0] < at:
                inside.append(pairs[k])
                k += 1
            if inside:
                inside = [p for p in inside if p[1] >= at]
                around = sorted((p for p in inside if p[1] < size or p[0] >= 0), key=lambda p: p[1])
        if thai:
            if not around and _thai(block, at - 1, -1) and _thai(block, end, 1):
                place = Place(at, "", *_word_after(block, at), "thai")
                place.script = "t"
                found.append(place)
            continue
        if c == "." and not around and 0 < at < size - 1 and block[at - 1].isdigit() and (block[end].isalnum()):
            continue  # inside a number, a date or a name: no space between words
        opened = None
        while around or end < len(block) and not block[end].isspace():  # the quotes and brackets that close right after the mark belong to it
            gap = 0
            while end + gap < len(block) and gap < 2 and block[end + gap] in " \xa0 ":
                gap += 1
            if around and end + gap < len(block) and around[0][1] == end + gap and (gap == 0 or block[end + gap] == "»"):
                opened = around.pop(0)[0]
                end += gap + 1
            elif end < len(block) and block[end] in "”’»›」』)）]】\"'" and not (block[end] in "\"'»" and end + 1 < len(block) and block[end + 1].isalnum()) and not any(p[0] == end for p in pairs):
                end += 1
            elif end < len(block) and opened is not None and block[end] in _MARKS:
                end += 1
            else:
                break
        if around:
            continue
        strong = c != "." and not _STRONG.isdisjoint(c)
        pause = not strong and (len(c) > 1 or c in "…‥")
        tight = end < len(block) and not block[end].isspace()
        before = block[at - 1] if at else " "
        script = "c" if "a" <= before <= "z" else _script(block, at, seen, script)
        seen = at
        word, begin = ("<...>", at) if pause else _word_before(block, at)
        place = Place(end, word, *_word_after(block, end), "strong" if strong else "pause" if pause else "dot")
        if 0 < len(word) <= 3 and not pause and word[-1].isalpha():
            place.pair = _pair(block, at - len(word), word)
        place.tight, place.script, place.wide = tight, script, c[0] in "。｡！？．।॥"
        if opened is not None:
            place.opened = opened
            place.kind = "bracket" if opened >= 0 and block[opened] in _BRACKETS else "quote"
            left = opened
            while left > 0 and block[left - 1].isspace():
                left -= 1
            place.colon = left > 0 and block[left - 1] in ":：︰"
            if opened < 0:  # the text begins inside this quotation
                place.colon = not block[:end].rstrip(_CLOSERS + " \xa0").endswith(("?", "？", "؟"))
        elif place.kind == "dot":
            place.marker = begin
            place.listed = bool(_LIST.match(block[place.marker : at])) and (place.marker == 0 or block[place.marker - 1].isspace())
        found.append(place)
    return _with_plain(block, found, pairs, plain) if plain else found


def _with_plain(block: str, found: list[Place], pairs: list[tuple[int, int]], plain: str) -> list[Place]:
    """The places with the spaces between words that are none, after letters of some scripts."""
    taken = {p.end for p in found}
    out, k, inside = list(found), 0, 0
    pairs = [*pairs, (len(block), len(block))]
    for m in regex.finditer(r"(?<=\S)\s+(?=\S)", block):
        while k < len(pairs) and pairs[k][0] < m.start():
            inside = max(inside, pairs[k][1])
            k += 1
        before = block[m.start() - 1]
        if m.start() in taken or m.start() < inside or not before.isalpha():
            continue
        script = script_of(before)
        if script in plain:
            place = Place(m.start(), "~" + _word_before(block, m.start())[0], *_word_after(block, m.start()), "plain")
            place.script = script
            out.append(place)
    return sorted(out, key=lambda p: p.end)


def blocks(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for m in _BLANK.finditer(text):
        yield at, text[at : m.start()]
        at = m.end()
    yield at, text[at:]


# ---------------------------------------------------------------- extracting

KINDS = ("dot", "strong", "pause", "quote", "bracket", "thai", "plain")
SCRIPTS = "cowt"
# bits of a place's flags, after 3 for its kind and 2 for its script; the second of two is for the case that the place
# before turns out to be a list item's marker
LISTED, TIGHT, COLON, BEGINS, BEGINS2, SHORT, SHORT2, LONE, LONE2, WIDE = (1 << k for k in range(5, 15))
# of the word before: its last part is a whole word, ends with a letter, ends with a digit before a wide mark; of the word after: capital, digit
WHOLE, LETTERED, DIGIT_BEFORE, CAPITAL, DIGIT_AFTER, ORDINARY_WORD = (1 << k for k in range(15, 21))
# then 4 bits for the class that the word after has by its shape, 2 for its script and 5 for the shape of the word before
CLASS_AT, AFTER_AT, SHAPE_AT = 21, 25, 27
_KIND, _SCRIPT = {k: i for i, k in enumerate(KINDS)}, {x: i for i, x in enumerate(SCRIPTS)}
#: Hashes of no word and of one that is known by its shape only.
NO_WORD, SHAPE_ONLY = 0, 1
#: One row for each text with anything but white space.
PLACES = "b_start array<int>, b_end array<int>, b_places array<int>, b_head array<bigint>, b_info array<int>, p_end array<int>, p_next array<int>, p_flags array<bigint>, p_word array<bigint>, p_pair array<bigint>, p_after array<bigint>"
_LISTS = pa.schema([(n, pa.list_(pa.int32() if t == "int" else pa.int64())) for n, t in regex.findall(r"(\w+) array<(\w+)>", PLACES)])
_HASHES: dict[str, int] = {}


def hashed(word: str) -> int:
    got = _HASHES.get(word)
    if got is None:
        if len(_HASHES) >= FLUSH:
            _HASHES.clear()
        h = xxhash.xxh64_intdigest(word)
        got = _HASHES[word] = h - (1 << 64) if h >> 63 else h
    return got


@lru_cache(maxsize=FLUSH)
def _about(token: str | None) -> tuple[int, int]:
    """(hash, class by its shape and script << 4) of a word after a place."""
    if token is None:
        return NO_WORD, END
    if token == ITEM:
        return SHAPE_ONLY, OPENS
    c = shape_class(token)
    m = _LETTER_AHEAD.search(token)
    info = c | (SCRIPTS.index(script_of(m.group())) if m else 0) << 4
    return SHAPE_ONLY if c == QUOTE or token[0] in ",;:，、،；；" or token.endswith(LONG_WORD) else hashed(token), info


@lru_cache(maxsize=FLUSH)
def _about_before(word: str) -> int:
    """Flags of a word before a place."""
    last = word.rsplit(".", 1)[-1]
    f = shape(word) << SHAPE_AT
    if len(last) > 2 and last[-1].isalpha() and "@" not in last and "/" not in last:
        f |= WHOLE
    if last[-1:].isalpha():
        f |= LETTERED
    if word[-1:].isdigit():
        f |= DIGIT_BEFORE
    return f | ORDINARY_WORD if ordinary(word) else f


def _begins(block: str, last_end: int, p: Place) -> bool:
    """Whether what a place closes (a quotation, dots, a list marker) stands at the beginning of a sentence that would begin at last_end."""
    if p.kind in ("quote", "bracket"):
        if p.opened < 0 or p.opened < last_end:
            return False
        return not any(ch.isalnum() for ch in _strip_marker(block[last_end : p.opened]))
    if p.kind == "pause":  # a pause after the first words of a sentence
        lead = block[last_end : p.end]
        if p.script == "w":
            return len(lead.strip(" .…‥。")) < 5
        return _few(lead, 3)
    return p.listed and not any(ch.isalnum() for ch in block[last_end : p.marker])


def _few(text: str, n: int) -> bool:
    """Whether a text has fewer than n words."""
    return len(text.split(None, n - 1)) < n


def _strip_marker(lead: str) -> str:
    """What stands before a quotation, without the number, letter or dash of a list item."""
    return _MARKER.sub("", lead) if lead and not lead.isspace() else ""


_MARKER = regex.compile(r"^\s*(?:[\(（]?(?:\p{N}{1,3}(?:\.\p{N}{1,3})*|\p{L})[.)）]|[-–—•*])\s*")


def _flags(block: str, found: list[Place], i: int) -> int:
    p = found[i]
    f = _KIND[p.kind] | _SCRIPT[p.script] << 3
    if p.tight:
        f |= TIGHT
    if p.wide:
        f |= WIDE
    last = found[i - 1].end if i else 0
    marker = i > 0 and found[i - 1].listed
    before = found[i - 2].end if i > 1 else 0
    if p.listed or p.kind in ("quote", "bracket", "pause"):
        f |= (LISTED if p.listed else 0) | (COLON if p.colon else 0)
        # a sentence in brackets seldom stands inside another
        wide = p.kind == "bracket" and p.script == "w" and p.end - p.opened > 6
        lone = wide or p.kind == "bracket" and not _few(block[p.opened : p.end], 3)
        if _begins(block, last, p):
            f |= BEGINS | (LONE if lone else 0)
        if marker and _begins(block, before, p):
            f |= BEGINS2 | (LONE2 if lone else 0)
        if wide:
            f |= LONE | LONE2
    if i and p.script != "w":
        if _few(block[last : p.end], 2):
            f |= SHORT
        if marker and i > 1 and _few(block[before : p.end], 2):
            f |= SHORT2
    c = p.after
    if c is not None:
        if c[0].isupper():
            f |= CAPITAL
        elif c[0].isdigit():
            f |= DIGIT_AFTER
    return f


class Sink:
    """The lists of PLACES of many texts, one after the other."""

    def __init__(self):
        self.lists: tuple[list, ...] = tuple([] for _ in _LISTS.names)

    def add(self, text: str, plain: str) -> tuple[int, int]:
        """Adds a text that is not all white space; the numbers of its blocks and places."""
        b_start, b_end, b_places, b_head, b_info, p_end, p_next, p_flags, p_word, p_pair, p_after = self.lists
        cuts = list(blocks(text))
        had, known = len(b_start), len(p_end)
        for n, (offset, block) in enumerate(cuts):
            head, start = _word_after(block, 0)
            if head is None:
                continue
            last = len(block.rstrip())
            found = places(block, n == 0, n == len(cuts) - 1, plain)
            b_start.append(offset + start)
            b_end.append(offset + last)
            b_places.append(len(found))
            h, info = _about(head) if n or not start else (NO_WORD, END)
            b_head.append(h)
            script = found[-1].script if found and found[-1].end == last else _script(block, last, 0, "c")
            marked = found != [] and found[-1].end == last and found[-1].kind not in ("thai", "plain")
            b_info.append(info | SCRIPTS.index(script) << 6 | marked << 8)
            for i, p in enumerate(found):
                h, info = _about(p.after)
                p_end.append(offset + p.end)
                p_next.append(offset + p.next)
                p_flags.append(_flags(block, found, i) | _about_before(p.word) | info << CLASS_AT)
                p_word.append(hashed(p.script + p.word))
                p_pair.append(hashed(p.script + p.pair) if p.pair else NO_WORD)
                p_after.append(h)
        return len(b_start) - had, len(p_end) - known


def _extracting(batches: Iterator[pa.RecordBatch], plain: str) -> Iterator[pa.RecordBatch]:
    """(key, lists of PLACES) of (key, text) rows; texts of white space give no row."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            sink, kept, sizes = Sink(), [], [(0, 0)]
            for i, t in enumerate(part.column(1).to_pylist()):
                if t and not t.isspace():
                    kept.append(i)
                    sizes.append(sink.add(t, plain))
            at = np.cumsum(np.array(sizes, dtype=np.int32), axis=0, dtype=np.int32)
            columns = [pa.ListArray.from_arrays(pa.array(at[:, 0 if f.name[0] == "b" else 1]), pa.array(x, f.type.value_type)) for f, x in zip(_LISTS, sink.lists)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept, pa.int64())), *columns], names=["id", *_LISTS.names])


# ---------------------------------------------------------------- the model

FEATURES = list(PRIORS)


class Model:
    """The n-gram model: classes of known words, P(class | event), and per row of what stands before P(event) and P(class | none)."""

    def __init__(self, known: tuple[np.ndarray, np.ndarray], after_event: np.ndarray, rate: np.ndarray, none: np.ndarray, words: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], plain: str):
        self.known, self.words, self.pairs = known, words, pairs  # sorted hashes, with classes or rows
        self.after_event, self.rate, self.none = after_event, rate, none
        self.plain = plain  # scripts in which a space between words alone may end a sentence

    def classes(self, after: np.ndarray, flags: np.ndarray) -> np.ndarray:
        hit, at = _find(after, self.known[0])
        return np.where(hit, self.known[1][at], flags >> CLASS_AT & 15)

    def events(self, flags: np.ndarray, word: np.ndarray, pair: np.ndarray, after: np.ndarray, second: bool | None) -> np.ndarray:
        """P(event) at each place: as if nothing began there (None), or as its flags say, for the first or the second case."""
        c, script, kind = self.classes(after, flags), flags >> 3 & 3, flags & 7
        begins = np.zeros(len(flags), dtype=bool) if second is None else flags & (BEGINS2 if second else BEGINS) != 0
        has = lambda bit: flags & bit != 0
        # rows: shapes, then features, then one for spaces of unpunctuated scripts, then words and pairs
        row = script * SHAPES + (flags >> SHAPE_AT & 31)
        by_shape = np.ones(len(flags), dtype=bool)
        for table in (self.words, self.pairs):
            hit, at = _find(word if table is self.words else pair, table[0])
            row = np.where(hit, table[1][at], row)
            by_shape &= ~hit
        feature = np.full(len(flags), -1)
        strong, quote, bracket, pause = (kind == KINDS.index(k) for k in ("strong", "quote", "bracket", "pause"))
        number = has(TIGHT) & ~has(WIDE) & has(DIGIT_AFTER)
        feature[strong] = np.where(number[strong], FEATURES.index("!9"), FEATURES.index("!"))
        feature[quote] = np.where(has(COLON), FEATURES.index('":'), np.where(begins, FEATURES.index('"o'), FEATURES.index('"m')))[quote]
        feature[bracket] = np.where(begins, FEATURES.index(")o"), FEATURES.index(")m"))[bracket]
        feature[kind == KINDS.index("thai")] = FEATURES.index("_")
        high = has(CAPITAL) | (flags >> CLASS_AT & 15 == QUOTE)
        feature[pause] = np.where(begins, FEATURES.index("…o"), np.where(high, FEATURES.index("…u"), -1))[pause]
        row = np.where(feature >= 0, _FEATURE_ROW + script * len(FEATURES) + feature, row)
        spaces = kind == KINDS.index("plain")
        row = np.where(spaces & by_shape, _SPACE_ROW + script, row)
        rate = self.rate[row]
        rare = by_shape & (feature < 0) & ~spaces & has(ORDINARY_WORD)  # a word too rare to be known
        rate = np.where(rare, np.maximum(rate, ORDINARY), rate)
        yes = rate * self.after_event[script, c]
        out = yes / (yes + (1 - rate) * self.none[row, c])
        out[(kind == 0) & has(LISTED) & begins] = 0.01
        # a full stop without a space stands inside a token (number, name, address), unless an ordinary word ends and one that opens sentences begins
        opens = (c == OPENS) | (c == QUOTE)
        inner = np.where(has(LETTERED) & (c == QUOTE), 0.7, 0.01)
        apart = np.where(has(WHOLE) & (has(CAPITAL) | opens), out * np.where(opens | (c == OFTEN), 0.9, 0.5), inner)
        tight = np.where(has(WIDE), np.where(has(DIGIT_AFTER) & has(DIGIT_BEFORE), 0.05, 0.98), apart)
        out = np.where((kind == 0) & has(TIGHT), tight, out)
        return np.where(flags >> CLASS_AT & 15 == END, 1.0, out)


_FEATURE_ROW = len(SCRIPTS) * SHAPES
_SPACE_ROW = _FEATURE_ROW + len(SCRIPTS) * len(FEATURES)
_FIRST_ROW = _SPACE_ROW + len(SCRIPTS)


def _find(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in a sorted table, and where (0 where they aren't)."""
    if not len(table):
        return np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    hit = table[at] == values
    return hit, np.where(hit, at, 0)


def _sorted(found: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array(list(found), dtype=np.int64)
    order = np.argsort(keys)
    return (keys[order], np.array(list(found.values()), dtype=np.int64)[order]) if found else (keys, np.zeros(1, dtype=np.int64))


# ---------------------------------------------------------------- training

def _fixed() -> np.ndarray:
    fixed = np.zeros(CLASSES)
    for c, p in _RARE_INSIDE.items():
        fixed[c] = p
    return fixed


def _normal(after: np.ndarray, script: str) -> np.ndarray:
    """P(class | event); a sentence seldom begins with a small letter, whatever the noise behind marks says."""
    after = after / after.sum()
    for c in (LOWER, MID):
        after[c] = min(after[c], 0.004 if script == "c" or c == LOWER else 0.02)
    least = np.full(CLASSES, 0.01)
    least[[LOWER, DIGIT, OTHER]] = 0.001
    after = np.maximum(after, least)
    return after / after.sum()


def _mixture(table: np.ndarray, sure: np.ndarray, script: str, prior: np.ndarray, strength: float, rounds: int = 60, learn: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM for rows of class counts: P(event) and P(class | no event) of each row, and P(class | event)."""
    fixed = _fixed()
    free = fixed == 0
    total = table.sum(1, keepdims=True)
    rate = np.clip(prior.copy(), 0.02, 0.98)
    base = table.sum(0) * free + 1.0 * free
    base = base / base.sum() * (1 - fixed.sum())
    none = np.tile(fixed + base, (len(table), 1))
    after = _normal(sure, script)
    for _ in range(rounds):
        yes = rate[:, None] * after
        resp = yes / (yes + (1 - rate[:, None]) * none)
        events = (table * resp).sum(1)
        rate = np.clip((events + strength * prior) / (total[:, 0] + strength), 1e-4, 1 - 1e-4)
        left = table * (1 - resp) * free + 0.5 * base
        none = fixed + (FLOOR * free / free.sum() + (1 - FLOOR) * left / left.sum(1, keepdims=True)) * (1 - fixed.sum())
        if learn:  # words that end sentences for the most part also tell how sentences begin
            mostly = rate > 0.7
            after = _normal(sure + (table * resp)[mostly].sum(0), script)
    return rate, none, after


def _feature_rates(rows: np.ndarray, after: np.ndarray, inside: np.ndarray, prior: np.ndarray, weight: np.ndarray, rounds: int = 60) -> np.ndarray:
    """EM for P(event) of each row, where what follows an event and what stands inside sentences are known."""
    total = rows.sum(1)
    strength, rate = 4.0 + weight * total, prior
    for _ in range(rounds):
        yes = rate[:, None] * after
        events = (rows * yes / (yes + (1 - rate[:, None]) * inside)).sum(1)
        rate = (events + strength * prior) / (total + strength)
    return rate


def _settled(rate: np.ndarray) -> np.ndarray:
    """Most words either end sentences wherever their mark stands or never do."""
    return np.where(rate > 0.75, np.maximum(rate, 0.99), np.where(rate < 0.03, np.minimum(rate, 0.01), rate))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, info, n): distinct raw tokens with their counts, as the model knows them."""
    for batch in batches:
        counts: Counter = Counter()
        for token, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not token.isascii() and _WIDE.search(token):
                for a, b in zip(token, token[1:]):
                    if _WIDE.match(a):
                        counts[_about(a + b)] += n
            else:
                counts[_about(_key(token) or token[0])] += n
        if counts:
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["b", "info", "n"])


def train(docs: DataFrame, text: str = "text") -> Model:
    """The model of a corpus; see sentences()."""
    model, _ = _learned(docs, text, None)
    return model


def extracted(docs: DataFrame, text: str, key: str | None = None, plain: str = "") -> DataFrame:
    """(id, lists of PLACES) of all texts; written by whoever uses it twice."""
    kind = "int" if key is None else docs.schema[key].dataType.simpleString()
    id_ = F.lit(0).alias("id") if key is None else F.col(key).alias("id")
    return docs.select(id_, F.col(text).cast("string").alias("t")).where("t is not null").mapInArrow(lambda b: _extracting(b, plain), f"id {kind}, {PLACES}")


def _learned(docs: DataFrame, text: str, key: str | None) -> tuple[Model, DataFrame]:
    """The model of a corpus, and its places as the model needs them."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.stage(extracted(docs, text, key))
    model = trained(docs, found, text)
    if model.plain:  # spaces between words are places too: they are counted, and decided, with them
        found = scratch.stage(extracted(docs, text, key, model.plain))
        model = trained(docs, found, text)
    return model, found


def trained(docs: DataFrame, found: DataFrame, text: str) -> Model:
    """Counts over all texts by native aggregates over the extracted places, then EM over a bounded table (driver)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    tokens = docs.select(F.explode(F.split(F.col(text).cast("string"), r"(?U)\s+")).alias("a")).where("a <> ''").groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    tokens = tokens.mapInArrow(_keyed, "b long, info int, n long")
    # kind: t word, i word that opens a block or sentence for sure, s word after a mark, p after a word, q after a pair, f after a feature, e end of a block
    zero = F.lit(0).cast("long")
    cell = lambda k, a=zero, w=zero, b=zero, info=F.lit(0), about=F.lit(0): F.struct(F.lit(k).alias("kind"), a.cast("long").alias("a"), w.cast("long").alias("w"), b.cast("long").alias("b"), info.cast("int").alias("info"), about.cast("int").alias("about"))
    head, info = F.col("b.b_head"), F.col("b.b_info").bitwiseAND(63)
    ends = F.array(F.when(head != NO_WORD, cell("i", b=head, info=info)), cell("e", a=F.shiftright("b.b_info", 6)))
    bounds = found.select(F.explode(F.arrays_zip("b_head", "b_info")).alias("b")).select(F.inline(F.array_compact(ends)))
    spots = found.select(F.explode(F.arrays_zip("p_flags", "p_word", "p_pair", "p_after")).alias("p")).select("p.*")
    f = F.col("p_flags")
    has = lambda bit: f.bitwiseAND(bit) != 0
    kind, script = f.bitwiseAND(7), F.shiftright(f, 3).bitwiseAND(3)
    info = F.shiftright(f, CLASS_AT).bitwiseAND(63)
    high = has(CAPITAL) | (info.bitwiseAND(15) == QUOTE)
    number = has(TIGHT) & ~has(WIDE) & has(DIGIT_AFTER)
    of = lambda name: F.lit(FEATURES.index(name))
    feature = (
        F.when(kind == 1, F.when(number, of("!9")).otherwise(of("!"))).when(kind == 3, F.when(has(COLON), of('":')).when(has(BEGINS), of('"o')).otherwise(of('"m')))
        .when(kind == 4, F.when(has(BEGINS), of(")o")).otherwise(of(")m"))).when(kind == 5, of("_")).when(kind == 2, F.when(has(BEGINS), of("…o")).when(high, of("…u")))
    )
    weak = kind.isin(0, 2, 6) & (~has(TIGHT) | (script == 2))
    # of the word before: script, shape, whether ordinary, whether before a space alone
    about = script + F.shiftleft(F.shiftright(f, SHAPE_AT).bitwiseAND(31), 2) + F.when(has(ORDINARY_WORD), 128).otherwise(0) + F.when(kind == 6, 256).otherwise(0)
    b = F.col("p_after")
    cells = F.array(
        F.when(kind == 1, cell("s", script, b=b, info=info)), F.when((kind == 1) & (b != NO_WORD), cell("i", b=b, info=info)), F.when(weak, cell("p", F.col("p_word"), b=b, info=info, about=about)),
        F.when(weak & (F.col("p_pair") != NO_WORD), cell("q", F.col("p_pair"), F.col("p_word"), b, info, about)), F.when(feature.isNotNull(), cell("f", script * len(FEATURES) + feature, b=b, info=info)),
    )
    keys = ["kind", "a", "w", "b", "info", "about"]
    local = bounds.unionByName(spots.select(F.inline(F.array_compact(cells)))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    words_at_large = tokens.select(F.lit("t").alias("kind"), zero.alias("a"), zero.alias("w"), "b", "info", F.lit(0).alias("about"), "n").groupBy(*keys).agg(F.sum("n").alias("n"))
    counts = scratch.stage(local.unionByName(words_at_large))
    total = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # one row a kind
    least, base = max(LEAST, int(total.get("t", 0) * SHARE)), total.get("i", 0) / max(1, total.get("t", 1))
    t, i = F.sum(F.when(F.col("kind") == "t", F.col("n")).otherwise(0)), F.sum(F.when(F.col("kind") == "i", F.col("n")).otherwise(0))
    often = counts.where(F.col("kind").isin("t", "i") & ~F.col("b").isin(NO_WORD, SHAPE_ONLY)).groupBy("b").agg(t.alias("t"), i.alias("i"), F.max(F.col("info").bitwiseAND(15)).alias("c"))
    often = often.where((F.col("t") >= least) & ~((F.col("t") < FEW) & (F.col("i") < 2)))  # of too few none can tell a word that never opens a sentence
    share = (F.col("i") + 0.5 * base) / (F.col("t") + 0.5) / max(base, 1e-9)
    known_class = F.when(share > 3, OPENS).when(share > 1, OFTEN).when(share > 0.2, SELDOM).when(F.col("c").isin(LOWER, DIGIT), F.col("c")).otherwise(MID)
    known = scratch.stage(often.select("b", known_class.cast("int").alias("known")))  # at most 1 / SHARE words
    # every count by the class of the word after; words and pairs that are seldom give theirs to their shape
    classed = counts.where("kind <> 'e'").join(F.broadcast(known), "b", "left").withColumn("c", F.coalesce("known", F.col("info").bitwiseAND(15)))
    group = F.when(F.col("kind").isin("t", "i"), F.shiftright("info", 4)).otherwise(F.col("a")).alias("a")
    classed = scratch.stage(classed.select("kind", group, "w", "about", "c", "n").groupBy("kind", "a", "w", "about", "c").agg(F.sum("n").alias("n")))
    heavy = classed.where("kind in ('p', 'q')").groupBy("kind", "a").agg(F.sum("n").alias("m")).where(F.col("m") >= least)
    rows = classed.join(heavy, ["kind", "a"], "left").where("kind <> 'q' or m is not null")
    own = F.col("m").isNotNull() | ~F.col("kind").isin("p", "q")
    # a shape's row is named by its script and shape; a row of spaces alone by its script
    shaped = F.when(F.col("about") >= 256, _SPACE_ROW + F.col("about") % 4).otherwise(F.col("about") % 4 * SHAPES + F.shiftright("about", 2) % 32)
    bounded = rows.select(F.when(own, F.col("kind")).otherwise("o").alias("kind"), F.when(own, F.col("a")).otherwise(shaped).alias("a"), F.when(own, F.col("w")).otherwise(0).alias("w"), F.when(own, F.col("about")).otherwise(0).alias("about"), "c", "n")
    tables: dict[str, dict[int, np.ndarray]] = {k: defaultdict(lambda: np.zeros(CLASSES)) for k in "tispqfo"}
    about_of, last_of = {}, {}
    for r in bounded.groupBy("kind", "a", "w", "about", "c").agg(F.sum("n").alias("n")).toLocalIterator():  # bounded: scripts, shapes, features, words of a share
        tables[r["kind"]][r["a"]][r["c"]] += r["n"]
        about_of[r["a"]], last_of[r["a"]] = r["about"], r["w"]
    marked = {r["a"]: r["n"] for r in counts.where("kind = 'e'").groupBy("a").agg(F.sum("n").alias("n")).collect()}  # two rows a script
    classes = _sorted({r["b"]: r["known"] for r in known.toLocalIterator()})
    return _estimated(classes, tables, about_of, last_of, marked)


def _estimated(known: tuple[np.ndarray, np.ndarray], tables: dict[str, dict[int, np.ndarray]], about: dict[int, int], last: dict[int, int], marked: dict[int, int]) -> Model:
    """The model from class counts: after sure events by script, and after places by word, by shape and by feature."""
    zero = np.zeros(CLASSES)
    # Thai's spaces are places in any case
    plain = "".join(x for k, x in enumerate(SCRIPTS) if x != "t" and marked.get(k, 0) and marked[k] >= UNMARKED * (marked[k] + marked.get(k | 4, 0)))
    rates, nones = np.full(_FIRST_ROW, 0.6), np.tile(np.full(CLASSES, 1 / CLASSES), (_FIRST_ROW, 1))
    after_event = np.zeros((len(SCRIPTS), CLASSES))
    more_rates, more_nones, words, pairs = [], [], {}, {}

    def keep(into: dict[int, int], names: list[int], rate: np.ndarray, none: np.ndarray) -> None:
        for n, r, x in zip(names, rate, none):
            into[n] = _FIRST_ROW + len(more_rates)
            more_rates.append(r)
            more_nones.append(x)

    for k, x in enumerate(SCRIPTS):
        here = lambda a: about[a] % 4 == k
        opening = tables["i"].get(k, zero) + 0.5
        sure = tables["s"].get(k, zero) + 0.5
        if x in plain or sure.sum() <= opening.sum() / 10:
            sure = opening  # where few marks tell how sentences begin, the blocks do
        shapes = np.array([tables["o"].get(k * SHAPES + n, zero) for n in range(SHAPES)])
        names = sorted(a for a in tables["p"] if here(a) and about[a] < 256)
        rows = np.array([*shapes, *[tables["p"][a] for a in names]])
        rate, none, _ = _mixture(rows, sure, x, np.full(len(rows), 0.6), 4.0)
        # most words of some length are ordinary ones; an abbreviation has to show it by what follows
        usual = [max(rate[about[a] >> 2 & 31], ORDINARY) if about[a] & 128 else rate[about[a] >> 2 & 31] for a in names]
        rate, none, after = _mixture(rows, sure, x, np.array([*rate[:SHAPES], *usual]), 4.0)
        after_event[k] = after
        rates[k * SHAPES : (k + 1) * SHAPES], nones[k * SHAPES : (k + 1) * SHAPES] = _settled(rate[:SHAPES]), none[:SHAPES]
        keep(words, names, _settled(rate[SHAPES:]), none[SHAPES:])
        alone = dict(zip(names, rate[SHAPES:]))
        twins = sorted(a for a in tables["q"] if here(a))
        if twins:  # a pair starts from what its second word says
            prior = np.array([alone.get(last[a], rate[about[a] >> 2 & 31]) for a in twins])
            r, n, _ = _mixture(np.array([tables["q"][a] for a in twins]), sure, x, prior, 4.0)
            keep(pairs, twins, _settled(r), n)
        # features: the counts move the prior; without an event a sentence goes on as sentences do inside
        inside = np.maximum(tables["t"].get(k, zero) - opening, 0.5)
        goes_on = np.maximum(np.where(np.arange(CLASSES) == END, _RARE_INSIDE[END], inside / inside.sum()), 1e-3)
        at = slice(_FEATURE_ROW + k * len(FEATURES), _FEATURE_ROW + (k + 1) * len(FEATURES))
        nones[at] = goes_on / goes_on.sum()
        rates[at] = _feature_rates(np.array([tables["f"].get(k * len(FEATURES) + n, zero) for n in range(len(FEATURES))]), after, nones[at][0], *np.array([PRIORS[n] for n in FEATURES]).T)
        if x in plain:  # spaces between words: nothing is known but how sentences begin
            gaps = sorted(a for a in tables["p"] if here(a) and about[a] >= 256)
            rows = np.array([tables["o"].get(_SPACE_ROW + k, zero), *[tables["p"][a] for a in gaps]])
            r, n, _ = _mixture(rows, sure, x, np.full(len(rows), 0.1), 4.0, learn=False)
            rates[_SPACE_ROW + k], nones[_SPACE_ROW + k] = r[0], n[0]
            keep(words, gaps, r[1:], n[1:])
    return Model(known, after_event, np.array([*rates, *more_rates]), np.array([*nones, *more_nones]), _sorted(words), _sorted(pairs), plain)


# ---------------------------------------------------------------- deciding

def _decided(lists: list[np.ndarray], model: Model, least: float) -> tuple[list[int], list[int], list[int]]:
    """(block, start, end) of each sentence of blocks with their places."""
    b_start, b_end, b_places, _, _, p_end, p_next, p_flags, p_word, p_pair, p_after = lists
    no = model.events(p_flags, p_word, p_pair, p_after, None)
    first, second = (np.where(p_flags & bit != 0, model.events(p_flags, p_word, p_pair, p_after, which), no) for bit, which in ((BEGINS, False), (BEGINS2, True)))
    ended = p_flags >> CLASS_AT & 15 == END
    no, first, second, ended, flags, end, following = (x.tolist() for x in (no, first, second, ended, p_flags, p_end, p_next))
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    at = 0
    for block, (start, stop, count) in enumerate(zip(b_start.tolist(), b_end.tolist(), b_places.tolist())):
        if count:
            # the marks of list items that open a block or follow an event belong to the sentence after
            kept: list[tuple[int, bool]] = []
            for k in range(at, at + count):
                f = flags[k]
                after_marker = k > at and (not kept or kept[-1][0] != k - 1)
                if f & LISTED and f & (BEGINS2 if after_marker else BEGINS) and not ended[k]:
                    if not kept:
                        continue
                    last, was_after = kept[-1]
                    if max(no[last], (second if was_after else first)[last]) > 0.5:
                        continue
                kept.append((k, after_marker))
            for (k, _), q in zip(kept, _posteriors(kept, flags, no, first, second)):
                if q > least:
                    if end[k] > start:
                        for x, y in zip(out, (block, start, end[k])):
                            x.append(y)
                    start = max(start, following[k])
            at += count
        if stop > start:
            for x, y in zip(out, (block, start, stop)):
                x.append(y)
    return out


def _posteriors(kept: list[tuple[int, bool]], flags: list[int], none: list[float], first: list[float], second: list[float]) -> list[float]:
    """P(boundary) at each place by forward-backward over (no event, event) at the place before; a block begins with a boundary."""
    a, b = 0.0, 1.0
    forward, steps = [], []
    for n, (k, after_marker) in enumerate(kept):
        f, no = flags[k], none[k]
        yes = (second if after_marker else first)[k]
        alone = 0.1 if f & (LONE2 if after_marker else LONE) else 1.0
        short = ONE_WORD if n and f & (SHORT2 if after_marker else SHORT) else 1.0
        stay, go, rest, cut = (1 - no) * alone, no * alone, 1 - yes, yes * short
        steps.append((stay, go, rest, cut))
        x, y = a * stay + b * rest, a * go + b * cut
        a, b = x / (x + y), y / (x + y)
        forward.append((a, b))
    out, u, v = [0.0] * len(kept), 1.0, 1.0
    for i in range(len(kept) - 1, -1, -1):
        x, y = forward[i][0] * u, forward[i][1] * v
        out[i] = y / (x + y)
        stay, go, rest, cut = steps[i]
        x, y = stay * u + go * v, rest * u + cut * v
        u, v = x / (x + y), y / (x + y)
    return out


def split(text: str | None, model: Model, least: float = 0.5) -> list[tuple[int, int]]:
    """(start, end) of each sentence, without white space around it."""
    if not text or text.isspace():
        return []
    sink = Sink()
    sink.add(text, model.plain)
    _, starts, stops = _decided([np.array(x, dtype=np.int64) for x in sink.lists], model, least)
    return list(zip(starts, stops))


def _deciding(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            lists = [c.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in part.columns[1:]]
            row_of = np.repeat(np.arange(part.num_rows), part.column(1).value_lengths().to_numpy(zero_copy_only=False))
            block, begins, stops = _decided(lists, model, 0.5)
            rows = row_of[np.array(block, dtype=np.int64)] if block else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(begins, pa.int64()), pa.array(stops, pa.int64())], names=["doc_id", "start_pos", "end_pos"])


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, start_pos, end_pos), one row per sentence, in code points from 0, end exclusive.

    Together a text's sentences hold all of it but white space. Null, empty and blank texts have none; a text without
    any mark is one sentence per block, unless its script is unpunctuated. Repeated rows give their sentences again.
    The model is trained on all of `docs` unless one is given; its size is bounded by SHARE.
    """
    if model is None:
        model, found = _learned(docs, text, key)
    else:
        found = extracted(docs, text, key, model.plain)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return found.mapInArrow(lambda b: _deciding(b, shared.value), f"doc_id {docs.schema[key].dataType.simpleString()}, start_pos long, end_pos long")

"""Personal data in texts, with disguises undone and spans in source characters.

Plain identifiers are found on the text as it stands. A chain of transducers then
rewrites disguises: look-alike characters, digits spelled as words, and ``at`` and
``dot`` written out. Each keeps, for every output character, the source characters it
stands for, so a span found on the normalised text maps back. Plain spans always stay;
a mapped-back span is added unless a plain one of its kind contains it, so a fragment
of a disguised identifier does not hide the whole. Redaction covers the union.

Words for ``at`` and ``dot`` count only together, in the shape of an address, and
spelled digits only in a run, so ordinary prose gives nothing.

Every pass is linear in the text: no pattern can start over inside a run it has read.

Defined results: a null text has no spans, as an empty one; rows are independent, so
repeated rows and null or repeated ids need no care; other columns pass through.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import types as T

from spoorline.llm.text import column_function

KINDS = ("email", "ip", "card", "phone")
SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("base", T.BooleanType()),
        ]
    )
)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "һ": "h", "ӏ": "l", "ո": "n", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "α": "a",
    "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "Α": "A", "Β": "B", "Ε": "E",
    "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "․": ".", "。": ".", "•": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-",
    "–": "-", "—": "-", "−": "-", "﹣": "-",
}
# Characters without width.
WIDTHLESS = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Digits as words.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9",
}

WORD = "|".join(DIGIT_WORDS)
SPELLED = re.compile(rf"(?<![a-z])(?:{WORD})(?![a-z])", re.I)
#: A run of digit words and digits, with the marks between them also as words.
RUN = re.compile(
    rf"(?<![a-z0-9])(?:(?:\+|plus)[ -]?)?(?:{WORD}|[0-9]++)(?![a-z])"
    rf"(?:(?:[ \t]?[,.()-]?[ \t]?(?:(?:dot|point|dash|hyphen|minus)[ \t])?)(?:{WORD}|[0-9]++)(?![a-z]))++",
    re.I,
)
PART = re.compile(rf"(?P<word>{WORD})|(?P<digits>[0-9]+)|(?P<plus>plus)|(?P<dot>dot|point)|(?P<dash>dash|hyphen|minus)|(?P<gap>[ \t]+)|(?P<mark>.)", re.I)
# Letters taken for digits.
LETTER_DIGITS = {"O": "0", "o": "0", "I": "1", "l": "1"}
#: Shapes in which they are, and the fewest true digits of each.
LETTERED = (
    (re.compile(r"(?<![A-Za-z0-9])[0-9OoIl]{3,5}(?:[ -]?[0-9OoIl]{3,5}){2,5}+(?![A-Za-z0-9])"), 10),
    (re.compile(r"(?<![A-Za-z0-9.])[0-9OoIl]{1,3}(?:\.[0-9OoIl]{1,3}){3}(?![A-Za-z0-9.])"), 3),
)
AT = r"[ \t]*[\[({<][ \t]*(?:at|@)[ \t]*[\])}>][ \t]*|[ \t]+(?:at|@)[ \t]+"
DOT = r"[ \t]*[\[({<][ \t]*(?:dot|\.)[ \t]*[\])}>][ \t]*|[ \t]+dot[ \t]+"
AT_SIGN = re.compile(rf"(?<=[A-Za-z0-9])(?:{AT}|@)(?=[A-Za-z0-9])", re.I)
HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:(?:{DOT}|[ \t]?\.[ \t]?)[A-Za-z0-9-]{{1,63}})+", re.I)
DOT_WORD = re.compile(DOT, re.I)
SPACED_DOT = re.compile(r"[ \t]?\.[ \t]?")
NAME = re.compile(rf"(?:[A-Za-z0-9._%+-]{{1,64}}(?:{DOT}))*[A-Za-z0-9._%+-]{{1,64}}$", re.I)
#: Characters before an ``at`` in which a name with spelled dots is looked for.
NAME_REACH = 160


def is_card(text: str) -> bool:
    """14 to 19 digits whose Luhn sum is a multiple of ten."""
    digits = DIGITS.sub("", text)
    if not 14 <= len(digits) <= 19:
        return False
    own = [int(d) for d in reversed(digits)]
    return (sum(own[::2]) + sum((2 * d) // 10 + (2 * d) % 10 for d in own[1::2])) % 10 == 0


def small_parts(text: str) -> bool:
    """Every part of an address is at most 255, however many zeros it begins with."""
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in text.split(".")))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from each @ outwards; a run of name characters is read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """Plain identifiers as (start, place of the kind in KINDS, end), sorted."""
    spans = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if small_parts(m[0])]
    spans += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if len(m[0]) >= 14 and is_card(m[0])]
    if "+" in text:
        spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGITS.sub("", m[0])) <= 15]
    return sorted(spans)


class Aligned:
    """A rewritten text; the pieces that differ in length from their source are listed."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.sources = [0], [(0, len(text), True)]

    @classmethod
    def joined(cls, source: Aligned, edits: list[tuple[int, int, str]]) -> Aligned:
        """``source`` with non-overlapping, ordered (start, end, new text) applied."""
        out, starts, sources, place, size = [], [], [], 0, 0

        def put(text: str, begin: int, end: int, same: bool):
            nonlocal size
            if text:
                starts.append(size)
                sources.append((begin, end, same))
                out.append(text)
                size += len(text)

        for begin, end, new in [*edits, (len(source.text), len(source.text), "")]:
            put(source.text[place:begin], place, begin, True)
            put(new, begin, end, False)
            place = end
        made = cls("".join(out))
        made.starts, made.sources = starts or [0], sources or [(0, 0, True)]
        made.source = source
        return made

    def _char(self, place: int) -> tuple[int, int]:
        """Source characters of one character of this text."""
        k = bisect_right(self.starts, place) - 1
        begin, end, same = self.sources[k]
        if same:
            begin += place - self.starts[k]
            end = begin + 1
        return begin, end

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text that a span of this text stands for."""
        begin, stop = self._char(start)[0], self._char(end - 1)[1]
        before = getattr(self, "source", None)
        return before.back(begin, stop) if before else (begin, stop)


def look_alike(char: str) -> str | None:
    """The plain character that another one looks like; '' if it has no width."""
    if char in WIDTHLESS:
        return ""
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    kind = unicodedata.category(char)
    if kind == "Nd":
        return str(unicodedata.digit(char))
    if kind == "Zs":
        return " "
    wide = unicodedata.normalize("NFKC", char)  # full-width and mathematical letters
    return wide if wide != char and len(wide) == 1 and "!" <= wide <= "~" else None


class LookAlikes(dict):
    def __missing__(self, char: str):
        self[char] = found = look_alike(char) if char > "\x7f" else None
        return found


FOREIGN = LookAlikes()
BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")


def plain_characters(text: Aligned) -> Aligned:
    """Look-alikes become the ASCII characters they imitate; widthless ones go."""
    strange = {c for c in set(text.text) if c > "\x7f" and FOREIGN[c] is not None}
    if not strange:
        return text
    found = re.finditer("[" + re.escape("".join(strange)) + "]", text.text)
    return Aligned.joined(text, [(m.start(), m.end(), FOREIGN[m[0]]) for m in found])


def digits_for_words(text: Aligned) -> Aligned:
    """Runs with spelled digits become digits; spaces between spelled digits go."""
    if not SPELLED.search(text.text):
        return text
    edits = []
    for run in RUN.finditer(text.text):
        if not SPELLED.search(run[0]):
            continue
        parts = [(p.lastgroup, run.start() + p.start(), run.start() + p.end(), p[0]) for p in PART.finditer(run[0])]
        for k, (kind, start, end, own) in enumerate(parts):
            near = {parts[j][0] for j in (k - 1, k + 1) if 0 <= j < len(parts)}
            new = {"word": DIGIT_WORDS.get(own.lower(), ""), "plus": "+", "dot": ".", "dash": "-"}.get(kind, own)
            if kind == "gap" and near & {"word", "plus", "dot", "dash"}:
                new = ""
            if kind == "mark" and own == "," and "word" in near | {parts[j][0] for j in (k - 2, k + 2) if 0 <= j < len(parts)}:
                new = ""
            if new != own:
                edits.append((start, end, new))
    return Aligned.joined(text, edits) if edits else text


def digits_for_letters(text: Aligned) -> Aligned:
    """Letters that look like digits become digits in what is otherwise a card or an address."""
    edits = []
    for pattern, least in LETTERED:
        for found in pattern.finditer(text.text):
            own = found[0]
            if len(DIGITS.sub("", own)) >= least:
                edits += [(found.start() + k, found.start() + k + 1, LETTER_DIGITS[c]) for k, c in enumerate(own) if c in LETTER_DIGITS]
    return Aligned.joined(text, sorted(set(edits))) if edits else text


def signs_for_words(text: Aligned) -> Aligned:
    """``name at host dot org`` and its bracketed forms become addresses."""
    edits, done, own = [], 0, text.text
    for at in AT_SIGN.finditer(own):
        if at.start() < done:
            continue
        host = HOST.match(own, at.end())
        if not host:
            continue
        spelled = list(DOT_WORD.finditer(own, host.start(), host.end()))
        sign = at[0].strip().lower()
        if sign == "at" and not spelled or at[0] == "@" and not spelled:
            continue  # "look at example.org" is prose, and a plain address is found anyway
        stop = host.end()
        if not spelled:  # "name @ host . org": a dot with a space behind it may end a sentence
            plain = DOMAIN.match(own, at.end())
            tight = re.match(r"[A-Za-z0-9-]+(?: \. [A-Za-z0-9-]+)+", own[at.end() : stop])
            if not plain and not tight:
                continue
            stop = at.end() + tight.end() if tight and not plain else plain.end()
        else:
            stop = max(stop if m.end() >= stop else m.end() for m in spelled)
            stop = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*").match(own, spelled[-1].end()).end()
        begin = max(done, at.start() - NAME_REACH)
        name = NAME.search(own[begin : at.start()])
        if not name:
            continue
        edits += [(begin + name.start() + m.start(), begin + name.start() + m.end(), ".") for m in DOT_WORD.finditer(name[0])]
        edits.append((at.start(), at.end(), "@"))
        for m in re.finditer(rf"{DOT}|[ \t]?\.[ \t]?", own[at.end() : stop], re.I):
            edits.append((at.end() + m.start(), at.end() + m.end(), "."))
        done = stop
    edits = [e for e in edits if own[e[0] : e[1]] != e[2]]
    return Aligned.joined(text, edits) if edits else text


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """All spans as (kind, start, end, plain), by start and then kind as listed."""
    text = text or ""
    base = identifiers(text)
    spans = [(s, k, e, True) for s, k, e in base]
    normal = signs_for_words(digits_for_letters(digits_for_words(plain_characters(Aligned(text)))))
    if hasattr(normal, "source"):
        taken = {k: sorted((s, e) for s, kk, e in base if kk == k) for k in range(len(KINDS))}
        for start, kind, end in identifiers(normal.text):
            s, e = normal.back(start, end)
            near = taken[kind]
            k = bisect_right(near, (s, len(text) + 1))
            if not (k and near[k - 1][1] >= e):
                spans.append((s, kind, e, False))
    return [(KINDS[k], s, e, plain) for s, k, e, plain in sorted(spans)]


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets."""
    if text is None:
        return None
    out, place = [], 0
    for kind, start, end, _ in find(text):
        if end <= place:
            continue
        if start >= place:
            out += [text[place:start], f"[{kind.upper()}]"]
        place = end
    return "".join(out) + text[place:]


@column_function(SPANS)
def spans(slices: Iterator[list]) -> Iterator[list]:
    """Column function: the spans of each text."""
    for texts in slices:
        yield [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in find(t)] for t in texts]


@column_function(T.StringType())
def redact(slices: Iterator[list]) -> Iterator[list]:
    """Column function: each text without its personal data."""
    for texts in slices:
        yield [redacted(t) for t in texts]

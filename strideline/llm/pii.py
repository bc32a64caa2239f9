"""Personal data behind disguises, found in a normalised text and mapped back to the source.

A text passes through four transducers: look-alike characters become ASCII and invisible ones
vanish, four number groups with written-out dots or spelled digits become an IP address, runs of
spelled digits become digits, written-out ``at`` and ``dot`` become ``@`` and ``.`` until no more
of them stand beside one another. Each character of the result knows the span of the source it came from, so that what the
plain patterns find there has a place in the original text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.llm.arrow import release, texts_of

# The patterns and what a match must hold.
KINDS = ("email", "ip", "card", "phone")
# An address is [A-Za-z0-9._%+-]+@ and a host, an IP four number groups up to 255. Both are found from the "@" or a whole
# chain of groups: a plain search would scan a long run again from each of its characters.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
GROUPS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Spelled digits in the four languages, by value.
DIGIT_WORDS = [
    "zero oh null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro",
    "five fünf cinq cinco", "six sechs", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve",
]
PLUS_WORDS = ("plus", "más")
#: A run of spelled digits counts from this length on.
MIN_SPELLED = 4

_VALUE = {word: str(digit) for digit, words in enumerate(DIGIT_WORDS) for word in words.split()}
_WORD = "|".join(sorted(_VALUE, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:(?:{'|'.join(PLUS_WORDS)})[ -]+)?(?:{_WORD})(?:[ ,-]+(?:{_WORD})){{{MIN_SPELLED - 1},}}(?!\w)", re.I)
_PART = re.compile(r"\w+")
# Spaces are taken from the first of a run only, so that a long run is not scanned from each.
_AT = re.compile(r"(?:(?<! )[ ]++)?[\[({<][ ]*(?:at|@|arroba)[ ]*[\])}>][ ]*", re.I)
_DOT = re.compile(r"(?:(?<! )[ ]++)?[\[({<][ ]*(?:dot|\.|punkt|punto|point)[ ]*[\])}>][ ]*", re.I)
DOT_WORDS = ("dot", "punkt", "punto", "point")
# Four number groups, each in digits or of up to three spelled ones; a dot between them may be written in any way.
_GROUP = rf"(?:[0-9]+|(?:{_WORD})(?:[ ,-]+(?:{_WORD})){{0,2}})"
_ANY_DOT = rf"(?:\.|[ ]+(?:{'|'.join(DOT_WORDS)})[ ]+|{_DOT.pattern})"
_CHAIN = re.compile(rf"(?<![\w.]){_GROUP}(?:{_ANY_DOT}{_GROUP}){{3}}(?!\w)", re.I)
_LINK = re.compile(_ANY_DOT, re.I)
# Without brackets both words must be there: "name at host dot org".
_TOP = "com|org|net|edu|gov|info|io|uk|eu|co|biz|example|test|de|fr|es"
_PLAIN_DOT = re.compile(rf"(?<! )[ ]+(?:{'|'.join(DOT_WORDS)})[ ]+", re.I)
_LABEL, _JOINT = "[A-Za-z0-9-]+", rf"(?:\.|{_PLAIN_DOT.pattern})"
_HOST = rf"{_LABEL}(?:{_JOINT}{_LABEL})*{_JOINT}(?:{_TOP})(?![A-Za-z0-9-])"
_PLAIN = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?P<at>[ ]+at[ ]+)(?P<host>{_HOST})", re.I)
# With a rewritten dot behind it, a plain "at" needs no known top-level name.
_PLAIN_AT = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?P<at>[ ]+at[ ]+)(?P<host>{_LABEL}(?:\.{_LABEL})+)", re.I)
# Beside an "@", plain dots count: any that come first behind it, later ones up to a top-level name, those of the name before it.
_BEHIND = re.compile(rf"(?<=[A-Za-z0-9._%+-]@){_HOST}", re.I)
_FIRST = re.compile(rf"(?<=[A-Za-z0-9._%+-]@){_LABEL}(?:{_PLAIN_DOT.pattern}{_LABEL})+", re.I)
_NOT_BEHIND = "".join(f"(?<! {word} )" for word in DOT_WORDS)  # a chain of names is tried from its head only
_BEFORE = re.compile(rf"(?<![A-Za-z0-9._%+-]){_NOT_BEHIND}(?:[A-Za-z0-9._%+-]+{_PLAIN_DOT.pattern})+(?=[A-Za-z0-9._%+-]+@[A-Za-z0-9-])", re.I)
_BRACKETED = re.compile(r"[\[({<][ ]*(?:at|dot|@|\.|arroba|punkt|punto|point)[ ]*[\])}>]")

# Letters that look like Latin ones, and characters that show as nothing.
_ALIKE = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅ", "aeopcyxijshdqwABEKMHOPCTYXIJS", strict=True))
_ALIKE |= dict(zip("ανορτυχικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "avoptuxikABEZHIKMNOPTYX", strict=True))
# Python takes these for their Latin letters where it ignores case, while lower() keeps them apart.
_ALIKE |= {"\u017f": "s", "\u0130": "I", "\u0131": "i", "\u212a": "K"}
_INVISIBLE = "­​‌‍⁠﻿"
_DASHES = dict.fromkeys("‐‑‒–−", "-")
_SPACES = dict.fromkeys("    ", " ")


@cache
def _substitutes() -> dict[str, str]:
    """Look-alikes of one character each; full-width and mathematical forms come from Unicode."""
    table = _ALIKE | _DASHES | _SPACES | dict.fromkeys(_INVISIBLE, "")
    for code in (*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x0660, 0x066A), *range(0x06F0, 0x06FA)):
        digit = unicodedata.digit(chr(code), None)
        plain = unicodedata.normalize("NFKC", chr(code)) if digit is None else str(digit)
        if len(plain) == 1 and plain.isascii():
            table[chr(code)] = plain
    return table


@cache
def _unusual() -> re.Pattern[str]:
    """Finds any substitute. Neighbouring characters are given as ranges, which are searched much faster than single ones."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, _substitutes())):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


@cache
def _number_pairs():
    """Finds two number words in a row."""
    import ahocorasick

    pairs = ahocorasick.Automaton()
    for one in _VALUE:
        for two in _VALUE:
            pairs.add_word(f"{one} {two}", True)
    pairs.make_automaton()
    return pairs


@dataclass
class Tape:
    """A normalised text; each character came from ``start:end`` of the source, by a change or not."""

    text: str
    start: list[int]
    end: list[int]
    changed: list[bool]

    @staticmethod
    def of(text: str) -> Tape:
        return Tape(text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text))

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace ``begin:end`` by a text, edits in order; an empty one takes no source along."""
        if not edits:
            return self
        text: list[str] = []
        out = Tape("", [], [], [])
        at, lost = 0, False
        for begin, end, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:begin] + new)
            out.start += self.start[at:begin]
            out.end += self.end[at:begin]
            kept = self.changed[at:begin]
            if kept and lost:
                kept[0] = True  # something vanished before it
            out.changed += kept
            lost = not new and end > begin
            for _ in new:
                out.start.append(self.start[begin])
                out.end.append(self.end[end - 1])
                out.changed.append(True)
            at = end
        out.text = "".join(text)
        return out


def _letters(tape: Tape) -> Tape:
    table = _substitutes()
    return tape.rewritten([(m.start(), m.end(), table[m[0]]) for m in _unusual().finditer(tape.text)])


def _digits(tape: Tape) -> Tape:
    edits = []
    for run in _SPELLED.finditer(tape.text):
        last = run.start()
        for word in _PART.finditer(tape.text, run.start(), run.end()):
            if word.start() > last:
                edits.append((last, word.start(), ""))
            edits.append((word.start(), word.end(), _VALUE.get(word[0].lower(), "+")))
            last = word.end()
    return tape.rewritten(edits)


def _octet(digits: str) -> bool:
    """At most 255, however many zeros lead."""
    value = digits.lstrip("0")
    return len(value) < 3 or (len(value) == 3 and value <= "255")


def _chains(tape: Tape) -> Tape:
    """Addresses of four number groups up to 255, with spelled digits and written-out dots, as digits and dots."""
    edits = []
    for chain in _CHAIN.finditer(tape.text):
        dots = list(_LINK.finditer(tape.text, *chain.span()))
        begins, ends = [chain.start(), *(d.end() for d in dots)], [*(d.start() for d in dots), chain.end()]
        groups = ["".join(_VALUE.get(w.lower(), w) for w in _PART.findall(tape.text, a, b)) for a, b in zip(begins, ends, strict=True)]
        if not all(map(_octet, groups)):
            continue
        for i, group in enumerate(groups):
            pieces = [(begins[i], ends[i], group)] + ([(*dots[i].span(), ".")] if i < len(dots) else [])
            edits += [(a, b, new) for a, b, new in pieces if tape.text[a:b] != new]
    return tape.rewritten(edits)


def _marks(tape: Tape) -> Tape:
    edits = [(m.start(), m.end(), "@") for m in _AT.finditer(tape.text)] + [(m.start(), m.end(), ".") for m in _DOT.finditer(tape.text)]
    tape = tape.rewritten(sorted(edits))
    while True:  # a mark found makes plain words beside it count; each round leaves fewer words
        edits = set()
        dots = lambda begin, end: {(d.start(), d.end(), ".") for d in _PLAIN_DOT.finditer(tape.text, begin, end)}  # noqa: E731, B023
        for pattern in (_PLAIN, _PLAIN_AT):
            for m in pattern.finditer(tape.text):
                plain = dots(*m.span("host"))
                if plain or any(tape.changed[i] and tape.text[i] == "." for i in range(*m.span("host"))):
                    edits |= plain | {(*m.span("at"), "@")}
        for pattern in (_BEHIND, _FIRST, _BEFORE):
            for m in pattern.finditer(tape.text):
                edits |= dots(*m.span())
        if not edits:
            return tape
        tape = tape.rewritten(sorted(edits))


def _luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    at, last = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        host = HOST.match(text, at + 1) if begin < at else None
        if host:
            yield begin, host.end()
        last = host.end() if host else at + 1
        at = text.find("@", last)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for chain in GROUPS.finditer(text):
        if chain[0].count(".") < 3:
            continue
        begin, groups = chain.start(), chain[0].split(".")
        for first in range(0, len(groups) - 3, 4):  # four by four: a match that fails is not tried again
            four = groups[first : first + 4]
            size = sum(map(len, four)) + 3
            if all(map(_octet, four)):
                yield begin, begin + size
            begin += size + 1


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of what the plain patterns find, by kind, then start."""
    out = [(0, *span) for span in _addresses(text)]
    if re.search("[0-9]", text):
        out += [(1, *span) for span in _ips(text)]
        for m in CARD.finditer(text) if len(text) > 15 else ():
            if m.end() - m.start() > 15 and 16 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def _disguised(text: str) -> bool:
    """A cheap test, true of any text that a transducer would edit."""
    low = text.lower()
    if any(f" {word} " in low for word in DOT_WORDS) or _BRACKETED.search(low):
        return True
    low = low.replace(",", " ").replace("-", " ")
    while "  " in low:
        low = low.replace("  ", " ")
    if next(_number_pairs().iter(low), None):
        return True
    return not text.isascii() and _unusual().search(text) is not None


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """What the patterns find in the text itself, and what only its normal form shows.

    A span of the second list rests on at least one changed character and is not inside one of the first.
    """
    plain = detect(text)
    if not _disguised(text):
        return plain, []
    tape = _marks(_digits(_chains(_letters(Tape.of(text)))))
    more = []
    for kind, begin, end in detect(tape.text):
        if any(tape.changed[begin:end]):
            start, stop = tape.start[begin], tape.end[end - 1]
            if not any(a <= start and stop <= b for _, a, b in plain):
                more.append((kind, start, stop))
    return plain, more


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, of the first kind."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in found):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text", redact: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """The key, ``base`` and ``spans``: (kind, start, end) in code points of the source, end exclusive,
    by kind, then start; ``spans`` holds those of ``base`` and the disguised ones. With ``redact``, also
    ``redacted``, the text without any of them (null stays null).

    A null text has no spans. Keys and the columns to ``keep`` pass through; others are dropped. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        named = lambda found: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in found]
        for batch in batches:
            for begin, texts in texts_of(batch, "text"):
                pairs = [spans(t) for t in texts]
                both = [sorted({*plain, *more}) if more else plain for plain, more in pairs]
                keys = batch.column("key").slice(begin, len(texts))
                columns = [keys, *(pa.array([named(f) for f in x], pa.list_(_SPAN)) for x in ([p for p, _ in pairs], both))]
                if redact:
                    known = batch.column("text").slice(begin, len(texts)).is_valid().to_pylist()
                    columns.append(pa.array([redacted(t, f) if k else None for t, f, k in zip(texts, both, known, strict=True)], pa.string()))
                columns += [batch.column(f"keep{i}").slice(begin, len(texts)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)))
    spans_type = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [T.StructField(key, source.schema["key"].dataType), T.StructField("base", spans_type), T.StructField("spans", spans_type)]
    fields += [T.StructField("redacted", T.StringType())] if redact else []
    fields += [T.StructField(name, source.schema[f"keep{i}"].dataType) for i, name in enumerate(keep)]
    return source.mapInArrow(run, T.StructType(fields))

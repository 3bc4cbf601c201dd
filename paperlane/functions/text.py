"""Text functions with Python's notion of white space, folding and word borders, as Column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, functions as F

from paperlane.model import let

SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same characters one by one, for ``btrim``; those below 128 form a class that Java looks up in a table.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_ASCII_SPACE = r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
LABEL_SEPARATORS = ":-\u2013\u2014=."
#: Where Latin letters with marks and combining marks end.
LATIN_END = 0x370
#: Single code points that fold to several, of Latin scripts and common typography; ``exact`` folds them all.
EXPANDED = {c: unicodedata.normalize("NFKD", c).casefold() for c in "ßẞﬀﬁﬂﬃﬄﬅﬆĳĲŉ…½¼¾™№₨℀℃ǆǉǌ"}


def fold(text: str) -> str:
    """Compatibility decomposition without combining marks, white space collapsed, case folded."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(plain.split()).casefold()


@cache
def _table(folded: bool = True) -> tuple[str, str]:
    """What ``translate`` replaces: code points that lose their marks (and case) and become one other, then those that vanish."""
    one, gone = [], []
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        if 0xD800 <= point < 0xE000 or char.isspace():
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        plain = plain.casefold() if folded else plain
        if not plain:
            gone.append(char)
        elif len(plain) == 1 and plain != char and point < 0x10000:
            one.append((char, plain))
    return "".join(c for c, _ in one) + "".join(g for g in gone if ord(g) < 0x10000), "".join(p for _, p in one)


@cache
def _small_table() -> tuple[str, str]:
    """The part of ``_table`` below ``LATIN_END``: comparing and searching the whole table is what folding a line costs."""
    source, target = _table()
    one = [(a, b) for a, b in zip(source, target) if ord(a) < LATIN_END]
    gone = [c for c in source[len(target) :] if ord(c) < LATIN_END]
    return "".join(a for a, _ in one) + "".join(gone), "".join(b for _, b in one)


@cache
def _cases() -> tuple[str, str, dict[str, str]]:
    """Code points that casefolding makes one other, what they become, and those that it makes several."""
    changed = {c: c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if c.casefold() != c}
    one = {c: f for c, f in changed.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in changed.items() if len(f) > 1}


def _jamo(text: Column) -> Column:
    """Each Hangul syllable as its two or three letters."""
    first, middle, last = ([F.lit(chr(base + k)) for k in range(n)] for base, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))

    def of(char: Column) -> Column:
        at = F.ascii(char) - 0xAC00
        parts = F.concat(F.get(F.array(*first), (at / 588).cast("int")), F.get(F.array(*middle), (at % 588 / 28).cast("int")), F.get(F.array(F.lit(""), *last), at % 28))
        return F.when((at >= 0) & (at < 11172), parts).otherwise(char)

    return F.array_join(F.transform(F.split(text, ""), of), "")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """White space as single blanks; ASCII texts that have no other, as most do, are only stripped."""
    plain = is_ascii(text) & ~F.contains(text, F.lit("  ")) & ~F.regexp_like(text, F.lit(f"[{_ASCII_SPACE}]"))
    return strip(F.when(plain, text).otherwise(F.regexp_replace(text, f"[{SPACE}]+", " ")))


def is_blank(text: Column) -> Column:
    """Null, empty or nothing but white space."""
    return text.isNull() | (F.ltrim(text, F.lit(SPACES)) == "")


def normalize(text: Column, how: str = "native") -> Column:
    """``fold`` as an expression; ``exact`` covers every code point in an Arrow UDF, ``native`` stays in the JVM."""
    if how == "exact":

        @F.arrow_udf("string")
        def run(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else fold(t) for t in texts.to_pylist()], pa.string())

        return run(text)
    out = _expanded(F.translate(text, *_table()), EXPANDED)
    few = {c: p for c, p in EXPANDED.items() if ord(c) < LATIN_END}
    has_few = F.regexp_like(text, F.lit("[" + "".join(few) + "]"))
    latin = let(F.translate(text, *_small_table()), lambda t: F.when(has_few, _expanded(t, few)).otherwise(t))
    is_latin = ~F.regexp_like(text, F.lit(rf"[^\x00-\x{{{LATIN_END - 1:X}}}]"))
    korean = F.regexp_like(text, F.lit(r"[\x{AC00}-\x{D7A3}]"))
    return let(F.when(is_ascii(text), F.lower(text)).when(is_latin, latin).when(korean, _jamo(out)).otherwise(out), collapse)


def _expanded(text: Column, several: dict[str, str]) -> Column:
    for char, plain in several.items():
        text = F.replace(text, F.lit(char), F.lit(plain))
    return text


def casefold(text: Column) -> Column:
    """Python's casefolding of every code point."""
    source, target, several = _cases()
    out = F.translate(text, source, target)
    long = out
    for char, plain in several.items():
        long = F.replace(long, F.lit(char), F.lit(plain))
    has_long = F.regexp_like(text, F.lit("[" + "".join(several) + "]"))
    return F.when(is_ascii(text), F.lower(text)).when(has_long, long).otherwise(out)


def without_marks(text: Column) -> Column:
    """``normalize`` without the folding of case, before white space is collapsed."""
    out = F.translate(text, *_table(False))
    return F.when(F.regexp_like(text, F.lit(r"[\x{AC00}-\x{D7A3}]")), _jamo(out)).otherwise(out)


def label_pattern(needle: str) -> str:
    """A pattern for ``needle`` between characters that are no letters or digits."""
    return rf"(?<![\p{{L}}\p{{N}}])\Q{needle}\E(?![\p{{L}}\p{{N}}])"


def label_position(line: Column, needle: str) -> Column:
    """Where a normalised label stands as a word in a normalised line, from 0; -1 where it doesn't."""
    begins = line.startswith(needle) & F.substring(line, len(needle) + 1, 1).isin("", " ", ":", "-", "=", ".")
    found = F.when(begins, 0).otherwise(F.regexp_instr(line, F.lit(label_pattern(needle))) - 1)  # most labels begin their line
    return F.when(F.contains(line, F.lit(needle)), found).when(line.isNotNull(), -1)


def lines_of(text: Column) -> Column:
    """Lines at every line border that Python knows, without an empty one at the end."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(_split_lines(text, LINE_END))


def lines_at_newlines(text: Column) -> Column:
    """Lines at newlines alone, as SQL splits them: an empty text is one empty line, other line borders stay in their lines."""
    return F.when(text == "", F.array(text)).otherwise(_split_lines(text, "\n"))


def _split_lines(text: Column, border: str) -> Column:
    parts = F.split(text, border)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def value_after(line: Column, normal: Column, label: Column, needle: Column) -> Column:
    """What stands behind a label in a raw line, without separators in between; '' where that can't be told.

    The label is found in the normalised line.  Where normalising changed the
    length its place doesn't carry over, and the label itself is searched.
    """
    plain = strip(line)
    at = F.instr(normal, needle)
    lowered = F.instr(casefold(line), casefold(label))
    same = F.substring(plain, at + F.length(needle), F.length(line))
    other = F.when(lowered > 0, F.substring(line, lowered + F.length(label), F.length(line))).otherwise("")
    tail = F.when(at == 0, "").when(F.length(normal) == F.length(plain), same).otherwise(other)
    return strip(F.ltrim(strip(tail), F.lit(LABEL_SEPARATORS)))


def glob_pattern(glob: str) -> str:
    """A shell pattern as a regular expression over whole names; ``*`` crosses folders."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body = glob[i + 1 : close]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"

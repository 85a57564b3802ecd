"""Text expressions: blanks, words, comments, doc/code links, byte-level token strings."""

from __future__ import annotations

import io
import tokenize
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What Python's str.isspace()/strip() treat as blank, as a regex class body.
BLANK = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# Separators and pad/end ids of the RoBERTa convention.
SEPARATOR = "</s>"

WORD_BREAK = r"[ \t\n\r\f]+"


def has_ink(text: Column) -> Column:
    """True when the text holds at least one character that is not blank (NULL stays NULL)."""
    return text.rlike(f"[^{BLANK}]")


def words(text: Column) -> Column:
    """The text's words as an array, without empty ones."""
    # One kind of blank, since a text is cut at a single letter without a pattern.
    for blank in "\t\n\r\f":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def drop_blank_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), has_ink), "\n")


# ---------------------------------------------------------------------------------------------------------------------
# Comments

# Literals are one group and comments another. Every quantifier over a literal's inside is possessive: the plain
# alternation recurses once per character in Java and overflows the stack on a long literal.
_LITERAL = r"""'[^\\']*+(?:\\[\s\S][^\\']*+)*+'|"[^\\"]*+(?:\\[\s\S][^\\"]*+)*+\""""
_COMMENT = r"//[^\n]*+|/\*[\s\S]*?\*/"
_OPEN, _SHUT, _ESC = "\x02", "\x01", "\x03"


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def strip_c_comments(code: Column) -> Column:
    """Replace ``//`` and ``/* */`` comments by a space, keep literals, drop blank lines.

    A match is rewritten to sentinel + literal + sentinel. An empty pair therefore was a comment. Code that already
    holds a sentinel is escaped first, so the whole operator stays a JVM expression.
    """
    odd = code.rlike("[\x01-\x03]")
    safe = F.when(odd, _swap(_swap(_swap(code, _ESC, _ESC + "c"), _OPEN, _ESC + "b"), _SHUT, _ESC + "a")).otherwise(code)
    marked = F.regexp_replace(safe, f"({_LITERAL})|{_COMMENT}", f"{_OPEN}$1{_SHUT}")
    bare = F.translate(_swap(marked, _OPEN + _SHUT, " "), _OPEN + _SHUT, "")
    back = F.when(odd, _swap(_swap(_swap(bare, _ESC + "a", _SHUT), _ESC + "b", _OPEN), _ESC + "c", _ESC)).otherwise(bare)
    return drop_blank_lines(back)


def comments(code: Column) -> Column:
    """All comments of a C-like source, in order, as an array of strings."""
    found = F.regexp_extract_all(code, F.lit(f"(?:{_LITERAL})|{_COMMENT}"), F.lit(0))
    return F.filter(found, lambda c: c.startswith("/"))


def comment_kind(comment: Column) -> Column:
    """``line``, ``doc`` (``/**`` with a body) or ``block``."""
    return (
        F.when(comment.startswith("//"), "line")
        .when(comment.startswith("/**") & (F.length(comment) > 4), "doc")
        .otherwise("block")
    )


#: Tokens that say nothing about what a logical line holds.
_LAYOUT = frozenset((tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING))


def _dropped_spans(source: str) -> Iterator[tuple[int, int]]:
    """Where comments and statements of nothing but strings lie in a Python source, as character offsets, in order.

    A logical line goes if each of its tokens is a string: adjacent strings make one. A string in brackets, after a colon or
    beside anything else is a value and stays, wherever it stands.
    """
    line_starts = [0, *accumulate(map(len, io.StringIO(source)))]
    offset = lambda place: line_starts[place[0] - 1] + place[1]
    line: list[tokenize.TokenInfo] = []
    remarks: list[tuple[int, int]] = []
    for token in tokenize.generate_tokens(io.StringIO(source).readline):
        if token.type == tokenize.COMMENT:
            remarks.append((offset(token.start), offset(token.end)))
        elif token.type in (tokenize.NEWLINE, tokenize.ENDMARKER):
            if line and all(t.type == tokenize.STRING for t in line):
                statement = (offset(line[0].start), offset(line[-1].end))
                remarks = sorted([statement, *(r for r in remarks if not statement[0] <= r[0] < statement[1])])
            yield from remarks
            line, remarks = [], []
        elif token.type not in _LAYOUT:
            line.append(token)


def _strip_one_python_source(source: str) -> str | None:
    """What lies between the dropped spans, without blank lines; continuation lines and trailing blanks stay."""
    try:
        spans = list(_dropped_spans(source))
    except (tokenize.TokenError, SyntaxError):
        return None
    begins, ends = [0, *(end for _, end in spans)], [*(begin for begin, _ in spans), len(source)]
    rest = "".join(map(source.__getitem__, map(slice, begins, ends)))
    return "\n".join(filter(str.strip, rest.split("\n")))


@F.pandas_udf(StringType())
def strip_python_comments(source: pd.Series) -> pd.Series:
    """Drop comments and statement-level strings, keep columns. NULL when the source cannot be tokenised."""
    return source.map(_strip_one_python_source, na_action="ignore")


def strip_comments(code: Column, language: Column | str, python: bool = False) -> Column:
    """Strip by language. Ruby passes unchanged and everything else is treated as C-like.

    ``python=True`` adds the Python branch, whose Arrow step runs for every row of the frame; leave it off for corpora
    without Python rows so that the plan stays inside the JVM.
    """
    lang = F.lit(language) if isinstance(language, str) else language
    chosen = F.when(lang == "ruby", code)
    if python:
        chosen = chosen.when(lang == "python", strip_python_comments(F.when(lang == "python", code)))
    return chosen.otherwise(strip_c_comments(code))


def link_doc_and_code(doc: Column, code: Column) -> Column:
    """``doc</s>code``; NULL when either side is NULL, so that failed rows can be filtered."""
    return F.concat(doc, F.lit(SEPARATOR), code)


# ---------------------------------------------------------------------------------------------------------------------
# Byte-level token strings


def _byte_alphabet() -> tuple[str, str]:
    """The bytes that have no printable Latin-1 form, and the letters from U+0100 on that stand for them."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in printable]
    return "".join(map(chr, hidden)), "".join(chr(0x100 + i) for i in range(len(hidden)))


_HIDDEN, _STAND_IN = _byte_alphabet()


def to_byte_letters(text: Column) -> Column:
    """Write every UTF-8 byte of the text as one printable letter (a space becomes ``Ġ``)."""
    # translate() ends its "from" side at NUL, so NUL is handled by replace().
    latin = _swap(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "\x00", _STAND_IN[0])
    return F.translate(latin, _HIDDEN[1:], _STAND_IN[1:])


def from_byte_letters(token: Column) -> Column:
    """The text behind byte letters; bytes that are no UTF-8 come back as U+FFFD."""
    latin = _swap(F.translate(token, _STAND_IN[1:], _HIDDEN[1:]), _STAND_IN[0], "\x00")
    return F.make_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string"))


def surface(token: Column) -> Column:
    """A token's text, or the token itself when it decodes to nothing but U+FFFD."""
    text = from_byte_letters(token)
    return F.when(text == "�", token).otherwise(text)


# Fixed value: the public GPT-2 split of a text into words, with the leading blank kept on the word.
BYTE_LEVEL_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level_words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(BYTE_LEVEL_WORD), F.lit(0)), to_byte_letters)

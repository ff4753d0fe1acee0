"""Tokens and their normal forms, as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters, marks and digits, or any other single non-blank character; the same in Java, RE2 and regex.
TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"
_PYTHON_TOKEN = re.compile(r"(?:(?!_)\w|[̀-ͯ])+|[^\s\w]|_")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def split_tokens(text: str) -> list[str]:
    """The tokens of a Python string, for the terms of a query."""
    return _PYTHON_TOKEN.findall(text)


def gaps(text: Column) -> Column:
    """The text behind each token up to the next one; what stands before the first is left out."""
    return F.slice(F.split(text, TOKEN), 2, F.greatest(F.size(F.split(text, TOKEN)) - 1, F.lit(1)))


def strip_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def _accented() -> tuple[str, str]:
    """Letters that decompose to one letter and marks, with that letter."""
    pairs = []
    for code in range(0xC0, 0x2000):
        plain = strip_accents(chr(code))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accented()


@dataclass(frozen=True)
class TermProcessor:
    """Normal form of terms: as an expression on the terms of an index, null for a term that is rejected, and for the
    terms of a query. Any other one than those below can be given to an index configuration."""

    name: str
    column: Callable[[Column], Column]
    literal: Callable[[str], str]


PROCESSORS = {
    p.name: p
    for p in (
        TermProcessor("none", lambda term: term, lambda term: term),
        TermProcessor("lower", F.lower, str.lower),
        # lower-case without combining marks; a term of one byte a character has none
        TermProcessor("accents", lambda term: F.when(F.octet_length(term) == F.length(term), F.lower(term)).otherwise(F.translate(F.regexp_replace(F.lower(term), r"\p{Mn}+", ""), _FROM, _TO)), strip_accents),
        TermProcessor("drop_empty", lambda term: F.when(term != "", term), lambda term: term),
    )
}


def processor_of(processor: str | TermProcessor) -> TermProcessor:
    if isinstance(processor, TermProcessor):
        return processor
    if processor not in PROCESSORS:
        raise ValueError(f"unknown term processor: {processor}")
    return PROCESSORS[processor]


def normalised(term: Column, processor: str | TermProcessor) -> Column:
    return processor_of(processor).column(term)


def normalised_literal(term: str, processor: str | TermProcessor) -> str:
    return processor_of(processor).literal(term)


def repaired(raw: Column) -> Column:
    """Text of bytes, with [?] for each run that isn't UTF-8."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\ufffd+", "[?]")

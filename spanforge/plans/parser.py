"""Query language: recursive descent without operator precedence.

An infix operator takes the one element before it as its left side and all that follows, up to the closing
bracket or the end, as its right side: ``a b | c d`` is SEQ(a, OR(b, SEQ(c, d))).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from spanforge.functions.text import split_tokens
from spanforge.plans.ast import And, Annotation, Constraint, Contains, Gap, Minus, Node, Number, Or, Repeats, Sequence, Term, Within


class QueryError(ValueError):
    """The query can't be read; the message says where."""


@dataclass(frozen=True)
class _Token:
    kind: str
    text: str
    at: int


_LETTER = r"$A-Z_a-zÀ-ÖØ-öø-῿぀-㆏㌀-㍿㐀-㴭一-鿿豈-﫿"
_DIGIT = r"0-9٠-٩۰-۹०-९০-৯"
_LEXER = re.compile(
    rf"""(?P<blank>\s+)
    |(?P<quoted>"(?:IN|OVER|AND|OR|REGEX|MINUS)")
    |(?P<string>"(?:[^"\\]|\\u[0-9A-Fa-f]{{4}}|\\[nrtbf"'\\])*")
    |(?P<number>[0-9]+)
    |(?P<word>[{_LETTER}][{_LETTER}{_DIGIT}]*)
    |(?P<sign>(?:\\[^\w\s]|[!£€¢%^*@'~#`¬;/])+)
    |(?P<op><=|>=|[<>{{}}().=:,|&+\-\[\]])
    """,
    re.X,
)
_KEYWORDS = {"OR": "|", "AND": "&", "MINUS": "MINUS", "IN": "IN", "OVER": "OVER", "REGEX": "REGEX"}
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
_INFIX = ("|", "&", "IN", "OVER", "MINUS")


def _unquote(text: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPES.get(m[2], m[2]), text[1:-1])


def _lex(query: str) -> list[_Token]:
    out, at = [], 0
    while at < len(query):
        m = _LEXER.match(query, at)
        if not m:
            raise QueryError(f"unexpected character {query[at]!r} at {at}")
        kind, text = m.lastgroup, m[0]
        if kind == "quoted":
            out.append(_Token("word", text[1:-1], at))
        elif kind == "string":
            out.append(_Token("string", _unquote(text), at))
        elif kind == "word" and text in _KEYWORDS:
            out.append(_Token("op", _KEYWORDS[text], at))
        elif kind == "sign":
            out.append(_Token("word", re.sub(r"\\(.)", r"\1", text), at))
        elif kind != "blank":
            out.append(_Token(kind, text, at))
        at = m.end()
    return out


class _Parser:
    def __init__(self, query: str) -> None:
        self.tokens, self.at, self.end = _lex(query), 0, len(query)

    def peek(self, ahead: int = 0) -> _Token:
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else _Token("end", "the end", self.end)

    def take(self, kind: str | None = None, text: str | None = None) -> _Token:
        t = self.peek()
        if (kind and t.kind != kind) or (text and t.text != text):
            raise QueryError(f"expected {text or kind} at {t.at}, not {t.text}")
        self.at += 1
        return t

    def is_op(self, *texts: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t.kind == "op" and t.text in texts

    def query(self) -> Node:
        node = self.group()
        if self.peek().kind != "end":
            raise QueryError(f"unexpected {self.peek().text} at {self.peek().at}")
        return node

    def group(self) -> Node:
        """Elements up to a closing bracket or the end."""
        parts: list[Node | Gap] = []
        while not (self.peek().kind == "end" or self.is_op(")")):
            t = self.peek()
            if self.is_op(*_INFIX):
                self.take()
                left, right = self.last(parts, t), self.group()
                parts[-1] = {"|": Or, "&": And}[t.text]((left, right)) if t.text in "|&" else {"IN": Within, "OVER": Contains, "MINUS": Minus}[t.text](left, right)
            elif self.is_op("+"):
                self.take()
                low = high = int(self.take("number").text)
                if self.is_op("."):
                    self.take(), self.take("op", ".")
                    high = int(self.take("number").text)
                else:
                    low = 1
                try:
                    parts[-1:] = [Repeats(self.last(parts, t), low, high)]
                except ValueError as e:
                    raise QueryError(f"{e}, at {t.at}") from e
            elif self.is_op("["):
                if not parts or isinstance(parts[-1], Gap):
                    raise QueryError(f"a gap must follow an element, at {t.at}")
                parts.append(self.gap())
            else:
                parts.append(self.element())
        if not parts:
            raise QueryError(f"a query is missing at {self.peek().at}")
        if isinstance(parts[-1], Gap):
            raise QueryError(f"a gap can't be the last element, at {self.peek().at}")
        nodes = tuple(p for p in parts if not isinstance(p, Gap))
        if len(nodes) == 1:
            return nodes[0]
        gaps, k = [], 1
        while k < len(parts):
            gaps.append(parts[k] if isinstance(parts[k], Gap) else Gap())
            k += 2 if isinstance(parts[k], Gap) else 1
        return Sequence(nodes, tuple(gaps))

    def last(self, parts: list, t: _Token) -> Node:
        if not parts or isinstance(parts[-1], Gap):
            raise QueryError(f"{t.text} needs an element before it, at {t.at}")
        return parts[-1]

    def gap(self) -> Gap:
        start = self.take("op", "[")
        low = high = int(self.take("number").text)
        if self.is_op("."):
            self.take(), self.take("op", ".")
            high = int(self.take("number").text)
        self.take("op", "]")
        try:
            return Gap(low, high)
        except ValueError as e:
            raise QueryError(f"{e}, at {start.at}") from e

    def element(self) -> Node:
        t = self.peek()
        if self.is_op("("):
            self.take()
            node = self.group()
            self.take("op", ")")
            return node
        if self.is_op("{"):
            return self.annotation()
        if t.kind == "word" and self.is_op(":", ahead=1):
            self.take(), self.take()
            value = self.peek()
            term = self.number() if value.kind == "number" or self.is_op("-") else self.take().text if value.kind in ("word", "string") else None
            if term is None:
                raise QueryError(f"expected a term at {value.at}, not {value.text}")
            return Term(term, t.text)
        if t.kind in ("word", "string"):
            return self.words(self.take().text, t)
        if t.kind == "number" or self.is_op("-"):
            return self.words(self.number(), t)
        raise QueryError(f"unexpected {t.text} at {t.at}")

    def words(self, text: str, t: _Token) -> Node:
        terms = split_tokens(text)
        if not terms:
            raise QueryError(f"no term in {text!r} at {t.at}")
        return Term(terms[0]) if len(terms) == 1 else Sequence(tuple(map(Term, terms)))

    def number(self) -> str:
        sign = self.take().text if self.is_op("-") else ""
        whole = self.take("number").text
        if self.is_op(".") and self.peek(1).kind == "number":
            self.take()
            return f"{sign}{whole}.{self.take('number').text}"
        return sign + whole

    def annotation(self) -> Annotation:
        self.take("op", "{")
        kind = self.take("word").text
        constraints = []
        while not self.is_op("}"):
            feature = self.take("word").text
            if self.is_op("."):
                self.take()
                self.take("op", "REGEX")
                self.take("op", "(")
                value, flags = self.take("string").text, ""
                if self.is_op(","):
                    self.take()
                    flags = self.take("string").text
                self.take("op", ")")
                constraints.append(Constraint(feature, "regex", value, flags))
                continue
            if not self.is_op("=", "<", "<=", ">", ">="):
                raise QueryError(f"expected a comparison at {self.peek().at}, not {self.peek().text}")
            op, value = self.take().text, self.peek()
            constraints.append(Constraint(feature, op, Number(self.number()) if value.kind == "number" or self.is_op("-") else self.take().text if value.kind in ("word", "string") else self.take("string").text))
        self.take("op", "}")
        return Annotation(kind, tuple(constraints))


def parse(query: str) -> Node:
    """The tree of a query; a QueryError says what is wrong with it."""
    return _Parser(query).query()

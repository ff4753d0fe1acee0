"""Nodes of a query. They are immutable and know nothing of Spark."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


class Node:
    """Any query that yields hits."""


class Number(str):
    """A number as it is written in a query: compared exactly with numbers, and as text with anything else."""


@dataclass(frozen=True)
class Term(Node):
    """Positions of a term in a token feature; the first feature if ``feature`` is None."""

    term: str
    feature: str | None = None
    length: int = 1


@dataclass(frozen=True)
class Constraint:
    """``op`` is one of = < <= > >= and regex; ``flags`` are those of a regex."""

    feature: str
    op: str
    value: Any
    flags: str = ""


@dataclass(frozen=True)
class Annotation(Node):
    type: str
    constraints: tuple[Constraint, ...] = ()


@dataclass(frozen=True)
class Gap:
    """Free tokens between two elements of a sequence."""

    low: int = 0
    high: int = 0

    def __post_init__(self) -> None:
        if not 0 <= self.low <= self.high:
            raise ValueError(f"a gap needs 0 <= min <= max, not {self.low}..{self.high}")


@dataclass(frozen=True)
class Sequence(Node):
    """Missing gaps are of no token, surplus ones are ignored."""

    nodes: tuple[Node, ...]
    gaps: tuple[Gap, ...] = ()

    def gap(self, k: int) -> Gap:
        return self.gaps[k] if k < len(self.gaps) else Gap()


@dataclass(frozen=True)
class Widened(Node):
    """Hits lengthened to the right."""

    node: Node
    gap: int


@dataclass(frozen=True)
class Repeats(Node):
    node: Node
    low: int
    high: int

    def __post_init__(self) -> None:
        if not 1 <= self.low <= self.high:
            raise ValueError(f"repeats need 1 <= min <= max, not {self.low}..{self.high}")


@dataclass(frozen=True)
class And(Node):
    nodes: tuple[Node, ...]


@dataclass(frozen=True)
class Or(Node):
    nodes: tuple[Node, ...]


@dataclass(frozen=True)
class Within(Node):
    inner: Node
    outer: Node


@dataclass(frozen=True)
class Contains(Node):
    outer: Node
    inner: Node


@dataclass(frozen=True)
class Minus(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Const(Node):
    """Documents by id, without hits."""

    doc_ids: tuple[int, ...]

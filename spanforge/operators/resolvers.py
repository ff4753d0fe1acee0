"""What turns the constraints of an annotation query into rows: the extension point for virtual features."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Callable
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.plans.ast import Constraint
from spanforge.sources.index import AnnotationType


class UnknownName(ValueError):
    """A feature, annotation type or token feature that the index doesn't have."""


class Resolver(ABC):
    """Selects rows of an annotation table by constraints."""

    @abstractmethod
    def rows(self, table: DataFrame, kind: AnnotationType, constraints: tuple[Constraint, ...]) -> DataFrame:
        """Rows that meet all constraints, each once."""


def comparison(kind: AnnotationType, c: Constraint) -> Column:
    """One constraint as a predicate. Null never matches; numbers compare with the literal as written."""
    try:
        of = kind.kind(c.feature)
    except KeyError:
        raise UnknownName(f"no feature {c.feature}") from None
    column, number = F.col(f"`{c.feature}`"), of in ("integer", "float")
    if c.op == "regex":
        if number:
            raise ValueError(f"a regular expression can't match the number {c.feature}")
        return F.regexp_like(column, F.lit(f"(?{c.flags}){c.value}" if c.flags else c.value))
    value = c.value
    if of == "integer":
        return _whole(column, c.op, _decimal(value))
    if number:
        value = float(_decimal(value))
    else:
        value = str(value)
    return {"=": column == value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[c.op]


def _decimal(value) -> Decimal:
    try:
        return Decimal(str(value))
    except InvalidOperation:
        raise ValueError(f"a number is expected, not {value!r}") from None


def _whole(column: Column, op: str, value: Decimal) -> Column:
    """Comparison of an integer column with any number, exact and pushed down to the scan as one of integers."""
    low, high = math.floor(value), math.ceil(value)
    if op == "=" and low != high:
        return F.lit(False)
    bound = {"=": low, "<": high, "<=": low, ">": low, ">=": high}[op]
    if not -(2**63) <= bound < 2**63:
        # beyond every integer of the column
        return column.isNotNull() & F.lit(op != "=" and (bound > 0) == (op in ("<", "<=")))
    x = F.lit(bound).cast("bigint")
    return {"=": column == x, "<": column < x, "<=": column <= x, ">": column > x, ">=": column >= x}[op]


def distinct_spans(rows: DataFrame, kind: AnnotationType, constraints: tuple[Constraint, ...]) -> DataFrame:
    """Spans of rows. Rows of equal span and equal nominal features are one hit, unless a constraint is on another
    kind of feature: then they are one only if those are equal too."""
    wide = any(c.feature in kind.features and kind.kind(c.feature) != "nominal" for c in constraints)
    names = kind.features if wide else kind.nominal
    return rows.select("doc_id", "start", "length", *[F.col(f"`{n}`") for n in names]).distinct().select("doc_id", "start", "length")


class ColumnResolver(Resolver):
    """Constraints on the table's own columns."""

    def rows(self, table: DataFrame, kind: AnnotationType, constraints: tuple[Constraint, ...]) -> DataFrame:
        checks = [comparison(kind, c) for c in constraints]
        return table.where(reduce(Column.__and__, checks)) if checks else table


class Delegating(Resolver):
    """Base of resolvers that rewrite constraints for another one."""

    def __init__(self, inner: Resolver | None = None) -> None:
        self.inner = inner or ColumnResolver()

    def rows(self, table: DataFrame, kind: AnnotationType, constraints: tuple[Constraint, ...]) -> DataFrame:
        return self.inner.rows(table, kind, constraints)


#: Unit -> (normalised unit, factor, offset): normalised = value * factor + offset.
UNITS = {
    "m": ("m", 1.0, 0.0), "cm": ("m", 0.01, 0.0), "mm": ("m", 0.001, 0.0), "km": ("m", 1000.0, 0.0), "inch": ("m", 0.0254, 0.0), "in": ("m", 0.0254, 0.0), "ft": ("m", 0.3048, 0.0), "mile": ("m", 1609.344, 0.0),
    "kg": ("kg", 1.0, 0.0), "g": ("kg", 0.001, 0.0), "mg": ("kg", 1e-6, 0.0), "lb": ("kg", 0.45359237, 0.0), "t": ("kg", 1000.0, 0.0),
    "s": ("s", 1.0, 0.0), "ms": ("s", 0.001, 0.0), "min": ("s", 60.0, 0.0), "h": ("s", 3600.0, 0.0), "day": ("s", 86400.0, 0.0),
    "k": ("K", 1.0, 0.0), "degc": ("K", 1.0, 273.15), "degf": ("K", 5 / 9, 459.67 * 5 / 9),
    "char": ("chars", 1.0, 0.0), "chars": ("chars", 1.0, 0.0), "kchar": ("chars", 1000.0, 0.0), "kchars": ("chars", 1000.0, 0.0),
    "l": ("l", 1.0, 0.0), "ml": ("l", 0.001, 0.0), "hz": ("Hz", 1.0, 0.0), "khz": ("Hz", 1000.0, 0.0), "pa": ("Pa", 1.0, 0.0), "bar": ("Pa", 1e5, 0.0),
}


def measure(value: float, unit: str) -> tuple[float, str]:
    try:
        normal, factor, offset = UNITS[unit.lower()]
    except KeyError:
        raise ValueError(f"unknown unit: {unit}") from None
    return value * factor + offset, normal


class MeasurementResolver(Delegating):
    """The virtual feature ``spec``: "n unit" or "n to m unit", on normalised units and values.

    A point matches equal values and intervals that hold it; a range matches values inside it and intervals that
    begin or end inside. One spec at most, and only with "=".
    """

    def rows(self, table: DataFrame, kind: AnnotationType, constraints: tuple[Constraint, ...]) -> DataFrame:
        specs = [c for c in constraints if c.feature == "spec"]
        rest = tuple(c for c in constraints if c.feature != "spec")
        out = super().rows(table, kind, rest)
        if not specs:
            return out
        if len(specs) > 1 or specs[0].op != "=":
            raise ValueError('one constraint on "spec" is allowed, and only "="')
        return out.where(self.predicate(str(specs[0].value)))

    def predicate(self, spec: str) -> Column:
        words = spec.split()
        value, low, high = (F.col(f"normalized{x}") for x in ("Value", "MinValue", "MaxValue"))
        try:
            if len(words) >= 4 and words[1].lower() == "to":
                (a, unit), (b, _) = (measure(float(words[k]), " ".join(words[3:])) for k in (0, 2))
                match = value.between(a, b) | low.between(a, b) | high.between(a, b)
            else:
                x, unit = measure(float(words[0]), " ".join(words[1:]))
                match = (value == x) | ((low <= x) & (high >= x))
        except (IndexError, ValueError) as e:
            raise ValueError(f"a measurement is expected, not {spec!r}: {e}") from e
        return (F.col("normalizedUnit") == unit) & match


class LookupResolver(Delegating):
    """A virtual feature whose value is a query to a provider: each row that it returns is a set of equalities.

    ``provider`` maps the query to a DataFrame whose columns are features. A column "error-message" with a value
    raises it. The rows are joined by a semi join, however many they are.
    """

    def __init__(self, provider: Callable[[str], DataFrame], feature: str = "sparql", inner: Resolver | None = None, prefix: str = "", suffix: str = "") -> None:
        super().__init__(inner)
        self.provider, self.feature, self.prefix, self.suffix = provider, feature, prefix, suffix

    def rows(self, table: DataFrame, kind: AnnotationType, constraints: tuple[Constraint, ...]) -> DataFrame:
        out = super().rows(table, kind, tuple(c for c in constraints if c.feature != self.feature))
        for c in constraints:
            if c.feature != self.feature:
                continue
            if c.op != "=":
                raise ValueError(f'only "=" is allowed on {self.feature}')
            found = self.provider(f"{self.prefix}{c.value}{self.suffix}")
            if "error-message" in found.columns and (bad := found.where("`error-message` is not null").first()):
                raise ValueError(bad["error-message"])
            keys = [k for k in found.columns if k != "error-message"]
            for k in keys:
                if k not in kind.features:
                    raise UnknownName(f"no feature {k}")
            out = out.join(found.select(*keys).distinct(), keys, "left_semi")
        return out


def described(features: tuple[str, ...], pattern: str | None = None) -> Column:
    """Text of a mention: its feature values in braces or, by a pattern, with each ${feature} replaced; null is empty."""
    if pattern is None:
        return F.concat(F.lit("{"), F.concat_ws(", ", *[F.when(F.col(f"`{f}`").isNotNull(), F.concat(F.lit(f"{f}="), F.col(f"`{f}`").cast("string"))) for f in features]), F.lit("}"))
    out = F.lit(pattern)
    for f in features:
        out = F.replace(out, F.lit("${" + f + "}"), F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")))
    return out


def ontology_described(ann_type: str, features: tuple[str, ...], local_names: bool = True, separator: str = "#") -> Column:
    """The name in the first feature, with that in the second in brackets; the annotation type where the first is
    null. Local names are what follows the first separator of a URI."""

    def name(f: str) -> Column:
        uri = F.col(f"`{f}`").cast("string")
        at = F.instr(uri, separator)
        return F.when(at > 0, uri.substr(at + len(separator), F.length(uri))).otherwise(uri) if local_names else uri

    if not features:
        return F.lit(ann_type)
    out = name(features[0])
    if len(features) > 1:
        second = name(features[1])
        out = F.when(second.isNotNull(), F.concat(out, F.lit(" ("), second, F.lit(")"))).otherwise(out)
    return F.when(name(features[0]).isNotNull(), out).otherwise(F.lit(ann_type))

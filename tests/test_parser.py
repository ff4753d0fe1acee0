import pytest

from spanforge.plans.ast import And, Annotation, Constraint, Contains, Gap, Minus, Number, Or, Repeats, Sequence, Term, Within
from spanforge.plans.parser import QueryError, parse

A, B, C, D = (Term(x) for x in "abcd")


@pytest.mark.parametrize(
    "text",
    [
        '{Measurement normalisedUnit="m"  normalisedValue<=30}', '"A AND OR B"', 'A "AND" \\+ "OR" B', "15 September 2007", "Thîs ís à teßt €12 and 23¢",
        '{A f1Key.REGEX("f1Value", "flags") f2Key="f2Value IN Quotes" f3Key>= 5.4 unit="1©" }', "{A} {B} ({A} | {B})", '({A} | {B}) IN ("Going for" [1..4] (root:trade | root:sale))',
        '{X f.REGEX("a.b")}', 'root:"two words"', "n:-5.5", "a \\{ b", "x:12", '"\\u0041\\n\\"q"',
    ],
)
def test_readable(text):
    assert parse(text)


def test_structure():
    assert parse("a") == A and parse("(a)") == A and parse('"a"') == A
    assert parse("a b") == Sequence((A, B), (Gap(),))
    assert parse("a [2] b [1..4] c") == Sequence((A, B, C), (Gap(2, 2), Gap(1, 4)))
    assert parse("root:be") == Term("be", "root")
    assert parse("a+3") == Repeats(A, 1, 3) and parse("a b+2..3") == Sequence((A, Repeats(B, 2, 3)), (Gap(),))
    assert parse("a IN b") == Within(A, B) and parse("a OVER b") == Contains(A, B) and parse("a MINUS b") == Minus(A, B)
    assert parse('"a b" c') == Sequence((Sequence((A, B)), C), (Gap(),))
    assert parse('{T x=1 y="s" z>-2.5 w.REGEX("p","i")}') == Annotation("T", (Constraint("x", "=", "1"), Constraint("y", "=", "s"), Constraint("z", ">", "-2.5"), Constraint("w", "regex", "p", "i")))
    assert isinstance(parse("{T x=007}").constraints[0].value, Number) and parse("{T x=007}").constraints[0].value == "007" and not isinstance(parse('{T x="7"}').constraints[0].value, Number)
    assert parse('"AND"') == Term("AND") and parse("\\+") == Term("+")


def test_no_precedence_right_greedy():
    assert parse("a b | c d") == Sequence((A, Or((B, Sequence((C, D), (Gap(),))))), (Gap(),))
    assert parse("a & b | c") == And((A, Or((B, C)))) and parse("a | b & c") == Or((A, And((B, C))))
    assert parse("(a & b) | c") == Or((And((A, B)), C)) and parse("a & b & c") == And((A, And((B, C))))


@pytest.mark.parametrize("text", ["", "[1] a", "a [1]", "a [1] [2] b", "| a", "a |", "(a", "a)", "a+0", "a+3..2", "a [3..1] b", "{}", "{A x}", "{A x=}", '"open', "a & [2] b", "IN a", "()", "a:"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)

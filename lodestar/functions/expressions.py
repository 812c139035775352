"""Expressions over an element's properties, with two-valued logic.

Equality treats nulls as values, an ordering comparison with a null is false, and so is its use under
a negation: the negation is then true. Comparisons stay plain at the top of a filter, so they push down.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_BEFORE, SPACE_AFTER = "(?U)^\\s+", "(?U)\\s+$"


class Expr:
    """A Column, the properties it reads, and whether it is a condition that can be null.

    ``name``: the property, if it is nothing else. ``bounds``: comparisons (property, operator, value)
    that must all hold where this condition does; statistics of files can rule some out.
    """

    __slots__ = ("bounds", "col", "maybe", "name", "reads")
    __hash__ = None

    def __init__(self, col: Column, reads: frozenset[str] = frozenset(), maybe: bool = False, name: str | None = None, bounds: tuple = ()):
        self.col, self.reads, self.maybe, self.name, self.bounds = col, reads, maybe, name, bounds

    def _bound(self, *found: tuple[str, Any]) -> tuple:
        plain = all(v is not None and not isinstance(v, (Expr, Column)) for _, v in found)
        return tuple((self.name, op, v) for op, v in found) if self.name and plain else ()

    def _bounded(self, made: Expr, *found: tuple[str, Any]) -> Expr:
        made.bounds = self._bound(*found)
        return made

    def _with(self, make: Callable[..., Column], *others: Any, maybe: bool = False) -> Expr:
        rest = [of(o) for o in others]
        return Expr(make(self.col, *(r.col for r in rest)), self.reads.union(*(r.reads for r in rest)), maybe)

    # comparisons
    def __eq__(self, other):
        return self._bounded(self._with(lambda a, b: a.eqNullSafe(b), other), ("==", other))

    def __ne__(self, other):
        return self._with(lambda a, b: ~a.eqNullSafe(b), other)

    def __lt__(self, other):
        return self._bounded(self._with(lambda a, b: a < b, other, maybe=True), ("<", other))

    def __le__(self, other):
        return self._bounded(self._with(lambda a, b: a <= b, other, maybe=True), ("<=", other))

    def __gt__(self, other):
        return self._bounded(self._with(lambda a, b: a > b, other, maybe=True), (">", other))

    def __ge__(self, other):
        return self._bounded(self._with(lambda a, b: a >= b, other, maybe=True), (">=", other))

    def compare(self, other) -> Expr:
        """-1, 0 or 1 as this string sorts before, with or after the other; nulls sort first.

        Compared with 0, it is a plain comparison with a constant, which pushes down.
        """
        found = self._with(lambda a, b: F.when(a.eqNullSafe(b), 0).when(a.isNull() | (a < b), -1).otherwise(1), other)
        return Compared(found, self, other) if isinstance(other, str) else found

    # logic
    def __and__(self, other):
        both = self._with(lambda a, b: a & b, other, maybe=self.maybe or of(other).maybe)
        both.bounds = self.bounds + of(other).bounds
        return both

    def __rand__(self, other):
        return of(other) & self

    def __or__(self, other):
        return self._with(lambda a, b: a | b, other, maybe=self.maybe or of(other).maybe)

    def __ror__(self, other):
        return of(other) | self

    def __invert__(self):
        return Expr(~F.coalesce(self.col, F.lit(False)), self.reads)

    def __bool__(self):
        raise TypeError("combine conditions with &, | and ~")

    def settled(self) -> Column:
        """The condition with null as false."""
        return F.coalesce(self.col, F.lit(False)) if self.maybe else self.col

    # arithmetic
    def __add__(self, other):
        return self._with(lambda a, b: a + b, other)

    def __radd__(self, other):
        return of(other) + self

    def __sub__(self, other):
        return self._with(lambda a, b: a - b, other)

    def __rsub__(self, other):
        return of(other) - self

    def __mul__(self, other):
        return self._with(lambda a, b: a * b, other)

    def __rmul__(self, other):
        return of(other) * self

    def __truediv__(self, other):
        return self._with(lambda a, b: a / b, other)

    def __rtruediv__(self, other):
        return of(other) / self

    def __mod__(self, other):
        return self._with(lambda a, b: a % b, other)

    def __neg__(self):
        return self._with(lambda a: -a)

    def whole_div(self, other):
        """Division of whole numbers, towards zero."""
        return self._with(lambda a, b: F.call_function("div", a, b), other)

    def abs(self):
        return self._with(F.abs)

    def floor(self):
        return self._with(F.floor)

    def ceiling(self):
        return self._with(F.ceil)

    def round(self, digits: int = 0):
        """Half to even."""
        return self._with(lambda a: F.bround(a, digits))

    # strings
    def starts_with(self, prefix):
        found = self._with(lambda a, b: a.startswith(b), prefix, maybe=True)
        return self._bounded(found, (">=", prefix), ("<=", prefix + "\U0010ffff")) if isinstance(prefix, str) else found

    def ends_with(self, suffix):
        return self._with(lambda a, b: a.endswith(b), suffix, maybe=True)

    def contains(self, part):
        return self._with(lambda a, b: a.contains(b), part, maybe=True)

    def equals_ignore_case(self, other):
        return self._with(lambda a, b: F.lower(a).eqNullSafe(F.lower(b)), other)

    def to_lower(self):
        return self._with(F.lower)

    def to_upper(self):
        return self._with(F.upper)

    def trim(self):
        """Without Unicode white space at either end."""
        return self._with(lambda a: F.regexp_replace(F.regexp_replace(a, SPACE_BEFORE, ""), SPACE_AFTER, ""))

    def is_null_or_empty(self):
        return self._with(lambda a: a.isNull() | (a == ""))

    def is_null_or_white_space(self):
        return self._with(lambda a: a.isNull() | a.rlike("(?U)^\\s*$"))

    def length(self):
        return self._with(F.length)

    def substring(self, start: int, length: int | None = None):
        """From a place counted from 0."""
        return self._with(lambda a: a.substr(start + 1, 2**31 - 1 - start if length is None else length))

    def replace(self, old: str, new: str):
        return self._with(lambda a: F.replace(a, F.lit(old), F.lit(new)))

    def index_of(self, part: str):
        """Place from 0, or -1."""
        return self._with(lambda a: F.instr(a, part) - 1)

    def concat(self, *others):
        return self._with(lambda *a: F.concat(*[F.coalesce(x.cast("string"), F.lit("")) for x in a]), *others)

    # dates
    def year(self):
        return self._with(F.year)

    def month(self):
        return self._with(F.month)

    def day(self):
        return self._with(F.dayofmonth)

    def date(self):
        return self._with(F.to_date)

    def add_days(self, days):
        return self._with(lambda a, b: F.date_add(a, b), days)

    # nulls, membership, conversion
    def or_else(self, other):
        return self._with(lambda a, b: F.coalesce(a, b), other)

    def has_value(self):
        return self._with(lambda a: a.isNotNull())

    def is_null(self):
        return self._with(lambda a: a.isNull())

    def is_in(self, values: Iterable):
        values = list(values)
        rest = [v for v in values if v is not None]
        none = None in values
        found = self._with(lambda a: (a.isin(rest) | a.isNull()) if none else a.isin(rest), maybe=not none)
        return self._bounded(found, (">=", min(rest)), ("<=", max(rest))) if rest and not none and len({type(v) for v in rest}) == 1 else found

    def choose(self, then, otherwise):
        """then where this condition holds, else otherwise."""
        return Expr(self.settled(), self.reads)._with(lambda a, b, c: F.when(a, b).otherwise(c), then, otherwise)

    def cast(self, kind: str):
        return self._with(lambda a: a.cast(kind))


class Compared(Expr):
    """The comparison of a string with a constant."""

    __slots__ = ("left", "right")
    __hash__ = None

    def __init__(self, whole: Expr, left: Expr, right: str):
        super().__init__(whole.col, whole.reads, whole.maybe)
        self.left, self.right = left, right

    def __eq__(self, other):
        return self.left == self.right if is_zero(other) else super().__eq__(other)

    def __ne__(self, other):
        return self.left != self.right if is_zero(other) else super().__ne__(other)

    def __lt__(self, other):
        return self.left._with(lambda a, b: a.isNull() | (a < b), self.right) if is_zero(other) else super().__lt__(other)

    def __le__(self, other):
        return self.left._with(lambda a, b: a.isNull() | (a <= b), self.right) if is_zero(other) else super().__le__(other)

    def __gt__(self, other):
        return self.left > self.right if is_zero(other) else super().__gt__(other)

    def __ge__(self, other):
        return self.left >= self.right if is_zero(other) else super().__ge__(other)


def is_zero(value: Any) -> bool:
    return type(value) is int and value == 0


def of(value: Any) -> Expr:
    if isinstance(value, Expr):
        return value
    return Expr(value if isinstance(value, Column) else F.lit(value))


lit = of


class Row:
    """Properties of the element at hand, as attributes or items."""

    def __init__(self, columns: Iterable[str], source: str | None = None):
        self._columns, self._source = {c.lower(): c for c in columns}, source

    def __getitem__(self, name: str) -> Expr:
        found = self._columns.get(name.lower())
        if found is None:
            raise AttributeError(f"no column {name}; there are {', '.join(self._columns.values())}")
        quoted = f"`{found}`"
        return Expr(F.col(f"{self._source}.{quoted}" if self._source else quoted), frozenset([found]), name=found)

    def __getattr__(self, name: str) -> Expr:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

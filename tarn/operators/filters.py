"""Filter expressions: alternatives of conjunctions, and the column that decides them.

The alternatives are kept because they decide which folds a rollup can answer; Spark gets one column and plans it itself.
A missing field makes a filter unknown, and unknown never matches; so != and not-in drop records without the field.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.errors import QueryFault
from tarn.functions import has_tokens
from tarn.schema import Entity
from tarn.types import FieldType, fits, kind

EQUALS, NOT_EQUALS, GREATER, AT_LEAST, LESS, AT_MOST = "==", "!=", ">", ">=", "<", "<="
IN, NOT_IN, BEGINS, CONTAINS, SEARCH = "in", "not in", "begins with", "contains", "search"
OPERATORS = (EQUALS, NOT_EQUALS, GREATER, AT_LEAST, LESS, AT_MOST, IN, NOT_IN, BEGINS, CONTAINS, SEARCH)


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: object

    @property
    def members(self) -> list | None:
        """The values of an equality or of an in."""
        if self.operator == EQUALS:
            return [self.value]
        if self.operator == IN:
            return list(self.value) if kind(self.value) == "list" else [self.value]
        return None


@dataclass(frozen=True)
class Expression:
    """Alternatives, each a tuple of filters that all must hold."""

    alternatives: tuple[tuple[Filter, ...], ...]

    def __and__(self, other: Expression) -> Expression:
        return Expression(tuple(a + b for a in self.alternatives for b in other.alternatives))

    def __or__(self, other: Expression) -> Expression:
        folded = _folded(self, other)
        return Expression(((folded,),)) if folded else Expression(self.alternatives + other.alternatives)


def _folded(one: Expression, other: Expression) -> Filter | None:
    """Two equalities (or ins) of one field and one sort of value are one in."""
    sides = [e.alternatives[0][0] for e in (one, other) if len(e.alternatives) == 1 and len(e.alternatives[0]) == 1]
    if len(sides) < 2 or sides[0].field != sides[1].field:
        return None
    members = [f.members for f in sides]
    if None in members or any(kind(f.value) == "list" for f in sides if f.operator == EQUALS):
        return None
    values = members[0] + [v for v in members[1] if v not in members[0]]
    kinds = {kind(v) for v in values}
    return Filter(sides[0].field, IN, tuple(values)) if len(kinds) == 1 and kinds <= {"string", "int", "double", "timestamp"} else None


@dataclass(frozen=True)
class Attribute:
    """attr("quantity") > 1 and the like; combine with & and |."""

    name: str

    def _filter(self, operator: str, value) -> Expression:
        return Expression(((Filter(self.name, operator, int(value) if isinstance(value, bool) else value),),))

    def __eq__(self, value) -> Expression:  # type: ignore[override]
        return self._filter(EQUALS, value)

    def __ne__(self, value) -> Expression:  # type: ignore[override]
        return self._filter(NOT_EQUALS, value)

    def __gt__(self, value) -> Expression:
        return self._filter(GREATER, value)

    def __ge__(self, value) -> Expression:
        return self._filter(AT_LEAST, value)

    def __lt__(self, value) -> Expression:
        return self._filter(LESS, value)

    def __le__(self, value) -> Expression:
        return self._filter(AT_MOST, value)

    def __hash__(self) -> int:
        return hash(self.name)

    def isin(self, values) -> Expression:
        return self._filter(IN, tuple(values) if kind(values) == "list" else values)

    def notin(self, values) -> Expression:
        return self._filter(NOT_IN, tuple(values) if kind(values) == "list" else values)

    def begins_with(self, prefix: str) -> Expression:
        return self._filter(BEGINS, prefix)

    def contains(self, value) -> Expression:
        return self._filter(CONTAINS, value)

    def search(self, words: str) -> Expression:
        return self._filter(SEARCH, words)


def attr(name: str) -> Attribute:
    return Attribute(name)


def condition(f: Filter, entity: Entity) -> Column:
    """The filter as a column: true, false, or null where it is unknown. Values of another sort never match."""
    field = entity.field(f.field)
    c, value, unknown = F.col(f"`{field.column}`"), f.value, F.lit(None).cast("boolean")
    if f.operator == SEARCH:
        if field.type is not FieldType.TEXT or field.payload:
            raise QueryFault("unsearchable_field", field=f.field)
        return has_tokens(c, value)
    if f.operator in (IN, NOT_IN):
        members = [v for v in replace(f, operator=IN).members if fits(field.type, v) and not field.type.is_list]
        found = c.isin(*members) if members else F.when(c.isNotNull(), F.lit(False))
        return found if f.operator == IN else ~found
    if f.operator == CONTAINS:
        if field.type.is_list:
            return F.array_contains(c, _literal(value)) if fits(field.type, value) else unknown
        return c.contains(value) if isinstance(c_type(field), str) and kind(value) == "string" else unknown
    if f.operator == BEGINS:
        return c.startswith(value) if isinstance(c_type(field), str) and kind(value) == "string" else unknown
    if field.type.is_list:
        if f.operator not in (EQUALS, NOT_EQUALS) or kind(value) != "list":
            return unknown
        same = c == F.array(*[_literal(v) for v in value]).cast(field.type.spark)
        return same if f.operator == EQUALS else ~same
    if kind(value) == "list" or not fits(field.type, value):
        return unknown
    right = _literal(value)
    if f.operator in (EQUALS, NOT_EQUALS):
        return c == right if f.operator == EQUALS else c != right
    if not field.type.ordered:
        return F.when(c.isNotNull(), F.lit(False))
    return {GREATER: c > right, AT_LEAST: c >= right, LESS: c < right, AT_MOST: c <= right}[f.operator]


def c_type(field) -> str | None:
    """Text, for filters on text."""
    return "text" if field.type in (FieldType.STRING, FieldType.TEXT, FieldType.REFERENCE) else None


def _literal(value) -> Column:
    return F.lit(bytearray(value)) if isinstance(value, bytes) else F.lit(value)


def predicate(alternatives: tuple[tuple[Filter, ...], ...], entity: Entity) -> Column | None:
    """One column for all alternatives; None where there is nothing to filter."""
    if any(not branch for branch in alternatives):
        for branch in alternatives:
            for f in branch:
                condition(f, entity)  # still refuses what it must
        return None
    branches = [reduce(lambda a, b: a & b, [condition(f, entity) for f in branch]) for branch in alternatives]
    return reduce(lambda a, b: a | b, branches)

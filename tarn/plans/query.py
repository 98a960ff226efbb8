"""The chainable query over one entity."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tarn.errors import QueryFault
from tarn.operators import rollups
from tarn.operators.filters import Expression, Filter, predicate
from tarn.plans import matching
from tarn.schema import COUNT, HISTOGRAM, MAX, MIN, SUM, Aggregate, Entity

UUID = "uuid"


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: the sort value and the uuid of its last record."""

    value: object
    uuid: object

    def encode(self) -> str:
        return base64.urlsafe_b64encode(json.dumps([self.value, self.uuid], default=str).encode()).decode()

    @staticmethod
    def decode(text: str) -> Cursor:
        return Cursor(*json.loads(base64.urlsafe_b64decode(text)))


@dataclass(frozen=True)
class Query:
    """Each call gives a new query. records: the entity's rows; cells: an aggregate's rollup."""

    entity: Entity
    records: DataFrame
    cells: Callable[[Aggregate], DataFrame]
    alternatives: tuple[tuple[Filter, ...], ...] = ((),)
    sorts: tuple[tuple[str, bool], ...] = ()
    ceiling: int | None = None
    key: str = UUID

    # what to read

    def filter(self, expression: Expression | str, operator: str | None = None, value=None) -> Query:
        if isinstance(expression, str):
            expression = Expression(((Filter(expression, operator, value),),))
        for branch in expression.alternatives:
            for f in branch:
                self.entity.field(f.field)
        return replace(self, alternatives=(Expression(self.alternatives) & expression).alternatives)

    def sort(self, name: str, reverse: bool = False) -> Query:
        return replace(self, sorts=(*self.sorts, (name, reverse)))

    def limit(self, n: int) -> Query:
        return replace(self, ceiling=n if self.ceiling is None else min(n, self.ceiling))

    # records

    def _found(self) -> DataFrame:
        keep = predicate(self.alternatives, self.entity)
        return self.records if keep is None else self.records.where(keep)

    def _order(self) -> list:
        """Earlier sorts first, missing values first (last in reverse), then the key, so that ties are settled."""
        order = []
        for name, reverse in self.sorts:
            field = self.entity.field(name)
            if not field.payload and not field.type.sortable:
                raise QueryFault("unsortable_field", field=name)
            c = F.col(f"`{field.column}`")
            order.append(c.desc_nulls_last() if reverse else c.asc_nulls_first())
        return [*order, F.col(self.key).asc()]

    def frame(self, n: int | None = None) -> DataFrame:
        """The records found, sorted where asked to be, at most n and at most the limit."""
        n = self.ceiling if n is None else n if self.ceiling is None else min(n, self.ceiling)
        order = self._order()
        found = self._found()
        if n is None:
            return found.orderBy(*order) if self.sorts else found
        return found.orderBy(*order).limit(n)

    def take(self, n: int) -> list[Row]:
        return self.frame(n).collect()

    def first_frame(self) -> DataFrame:
        return replace(self, ceiling=None).frame(1)

    def first(self) -> Row | None:
        return self.first_frame().first()

    def page_frame(self, size: int, after: Cursor | None = None) -> DataFrame:
        """A page in the order of its one sort, then of the key; records without the field are on no page."""
        if len(self.sorts) != 1:
            raise QueryFault("single_sort_required")
        name, reverse = self.sorts[0]
        field = self.entity.field(name)
        if field.payload or not field.type.pageable:
            raise QueryFault("unpageable_field", field=name)
        c, k = F.col(f"`{field.column}`"), F.col(self.key)
        rows = self._found().where(c.isNotNull())
        if after is not None:
            value = F.lit(after.value).cast(field.type.spark)
            beyond = c < value if reverse else c > value
            rows = rows.where(beyond | ((c == value) & (k > F.lit(after.uuid))))
        return rows.orderBy(c.desc() if reverse else c.asc(), k.asc()).limit(size)

    def page(self, size: int, after: Cursor | str | None = None) -> tuple[list[Row], Cursor | None]:
        """The page's records, and the cursor of the next one: none after a page that is not full."""
        after = Cursor.decode(after) if isinstance(after, str) else after
        rows = self.page_frame(size, after).collect()
        column = self.entity.field(self.sorts[0][0]).column
        return rows, Cursor(rows[-1][column], rows[-1][self.key]) if size > 0 and len(rows) == size else None

    # folds over rollups

    def _among(self, aggregate: Aggregate, keys: list[str | float] | None) -> DataFrame:
        cells = self.cells(aggregate)
        return cells if keys is None else cells.where(matching.in_groups(F.col("grp"), keys))

    def count_frame(self) -> DataFrame:
        aggregate, keys = matching.scalar(self.entity, self.alternatives, None, COUNT)
        n = F.coalesce(F.col("value"), F.lit(0.0)).cast("long")
        return rollups.fold(self._among(aggregate, keys), aggregate).select((n if self.ceiling is None else F.least(n, F.lit(self.ceiling))).alias("value"))

    def _fold(self, name: str, metric: str) -> DataFrame:
        matching.numeric(self.entity, name, metric)
        aggregate, keys = matching.scalar(self.entity, self.alternatives, name, metric)
        return rollups.fold(self._among(aggregate, keys), aggregate)

    def sum_frame(self, name: str) -> DataFrame:
        return self._fold(name, SUM).select(F.coalesce("value", F.lit(0.0)).alias("value"))

    def min_frame(self, name: str) -> DataFrame:
        return self._fold(name, MIN)

    def max_frame(self, name: str) -> DataFrame:
        return self._fold(name, MAX)

    def average_frame(self, name: str) -> DataFrame:
        """The sum of the field over the count of all records; null where either is missing or nothing is counted."""
        matching.numeric(self.entity, name, "average")
        total = self._fold(name, SUM)
        aggregate, keys = matching.scalar(self.entity, self.alternatives, None, COUNT)
        n = rollups.fold(self._among(aggregate, keys), aggregate).withColumnRenamed("value", "n")
        both = total.withColumn("n", F.lit(None).cast("double")).unionByName(n.withColumn("value", F.lit(None).cast("double")))
        return both.agg(F.max("value").alias("value"), F.max("n").alias("n")).select(F.when(F.col("n") != 0, F.col("value") / F.col("n")).alias("value"))

    def count(self) -> int:
        return self.count_frame().first()["value"]

    def sum(self, name: str) -> float:
        return self.sum_frame(name).first()["value"]

    def min(self, name: str) -> float | None:
        return self.min_frame(name).first()["value"]

    def max(self, name: str) -> float | None:
        return self.max_frame(name).first()["value"]

    def average(self, name: str) -> float | None:
        return self.average_frame(name).first()["value"]

    def _grouped(self, name: str | None, metric: str, group: str | None, fold) -> DataFrame:
        def cells(field: str | None, kind: str) -> DataFrame:
            aggregate, keys = matching.grouped(self.entity, self.alternatives, group, field, kind)
            return fold(self._among(aggregate, keys), aggregate)

        if name is not None:
            matching.numeric(self.entity, name, metric)
        if name is None or metric != "average":
            return cells(name, metric)
        total, n = cells(name, SUM), cells(None, COUNT)
        return rollups.ratio(total, n, [c for c in total.columns if c != "value"])

    def totals(self, name: str | None = None, metric: str = COUNT, group: str | None = None) -> DataFrame:
        """(grp, value) for each group, by group; without a field, counts."""
        return self._grouped(name, metric, group, rollups.totals).orderBy("grp")

    def series(self, start, end, name: str | None = None, metric: str = COUNT, group: str | None = None) -> DataFrame:
        """(grp, hour, value) for each hour that begins in [start, end) and has a cell, by hour and group."""
        return self._grouped(name, metric, group, lambda cells, a: rollups.series(cells, a, start, end)).orderBy("hour", "grp")

    def percentile_frame(self, rank: float, name: str) -> DataFrame:
        if any(self.alternatives):
            raise QueryFault("filtered_histogram")
        if not 0 <= rank <= 1:
            raise QueryFault("rank_out_of_range", rank=rank)
        self.entity.field(name)
        aggregate = next((a for a in self.entity.aggregates if a.metric == HISTOGRAM and a.field == name), None)
        if aggregate is None:
            raise QueryFault("no_histogram", entity=self.entity.name, field=name)
        return rollups.percentile(self.cells(aggregate), aggregate, rank)

    def percentile(self, rank: float, name: str) -> float | None:
        return self.percentile_frame(rank, name).first()["value"]


def over(entity: Entity, records: DataFrame, key: str = UUID, written=None) -> Query:
    """A query over a table as it stands: rollups are built from it when a fold needs one. written: when a record without
    a date counts as written (1970 if nothing is given)."""
    at = written if written is not None else F.lit("1970-01-01").cast("timestamp")
    return Query(entity, records, lambda a: rollups.build(records, a, entity, at), key=key)

"""Entities: fields with constraints and version windows, and the rollups declared over them."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import asdict, dataclass, field, replace

from tarn.errors import DefinitionFault, SchemaError
from tarn.functions import compiles
from tarn.types import PAYLOAD_CAPACITY, FieldType

COUNT, SUM, MIN, MAX, HISTOGRAM = "count", "sum", "min", "max", "histogram"
METRICS = (SUM, MIN, MAX)


@dataclass(frozen=True)
class Field:
    name: str
    type: FieldType
    payload: bool = False
    required: bool = False
    default: object = None
    allowed: tuple[str, ...] | None = None
    min: float | None = None
    max: float | None = None
    pattern: str | None = None
    ungrouped: bool = False
    since: int | None = None
    until: int | None = None

    def active(self, version: int) -> bool:
        return (self.since or 1) <= version and (self.until is None or version < self.until)

    @property
    def column(self) -> str:
        """Its physical column: fields of one name and different windows do not share one."""
        return self.name if (self.since or 1) == 1 else f"{self.name}__v{self.since}"

    @property
    def always_present(self) -> bool:
        return self.required or self.default is not None

    @property
    def groupable(self) -> bool:
        return self.type.counted and not self.ungrouped and not self.payload


@dataclass(frozen=True)
class Aggregate:
    """metric of field (count: none) for each value of group, by the hour of date (none: of writing)."""

    metric: str = COUNT
    field: str | None = None
    group: str | None = None
    date: str | None = None
    bounds: tuple[float, ...] | None = None
    shards: int | None = None
    since: int = 1

    @property
    def name(self) -> str:
        parts = [] if self.metric == COUNT else [self.metric, self.field]
        parts += [f"by_{self.group}"] if self.group else []
        parts += [f"at_{self.date}"] if self.date else []
        return "_".join(parts) or "by_all"

    @property
    def storage(self) -> str:
        """How cells of the same group combine."""
        return self.metric if self.metric in (MIN, MAX) else SUM


@dataclass(frozen=True)
class Entity:
    name: str
    version: int = 1
    fields: tuple[Field, ...] = ()
    aggregates: tuple[Aggregate, ...] = field(default=())

    def active_fields(self, version: int | None = None) -> list[Field]:
        return [f for f in self.fields if f.active(version or self.version)]

    def field(self, name: str) -> Field:
        for f in self.active_fields():
            if f.name == name:
                return f
        raise SchemaError("unknown_field", entity=self.name, field=name)

    def validate(self) -> Entity:
        if self.name.startswith("__"):
            raise DefinitionFault("reserved_entity", entity=self.name)
        pools = Counter(f.type for f in self.fields if not f.payload)
        for kind, n in pools.items():
            if n > kind.capacity - kind.reserved:
                raise DefinitionFault("exhausted_pool", type=kind.label)
        if sum(f.payload for f in self.fields) > PAYLOAD_CAPACITY:
            raise DefinitionFault("exhausted_payload")
        for f in self.fields:
            self._validate_field(f)
        for one in self.fields:
            for other in self.fields:
                if one is not other and one.name == other.name and _overlap(one, other):
                    raise DefinitionFault("shared_slot", field=one.name, other=other.name)
        self._validate_aggregates()
        return self

    @staticmethod
    def _validate_field(f: Field) -> None:
        texts = (FieldType.STRING, FieldType.TEXT, FieldType.STRING_LIST)
        if f.pattern is not None:
            if f.type not in texts:
                raise DefinitionFault("unsupported_pattern", field=f.name, type=f.type.label)
            if not compiles(f.pattern):
                raise DefinitionFault("malformed_pattern", field=f.name)
        if f.allowed is not None and f.type not in texts:
            raise DefinitionFault("unsupported_allowed", field=f.name, type=f.type.label)
        base = f.type.element if f.type.is_list else f.type
        if (f.min is not None or f.max is not None) and not base.numeric:
            raise DefinitionFault("unsupported_bounds", field=f.name, type=f.type.label)

    def _validate_aggregates(self) -> None:
        active = {f.name: f for f in self.active_fields()}
        every = {f.name: f for f in self.fields} | active
        seen = set()
        for a in self.aggregates:
            if a.name in seen:
                raise DefinitionFault("duplicate_aggregate", aggregate=a.name)
            seen.add(a.name)
            if a.group is not None and a.group not in active:
                raise DefinitionFault("unknown_grouping", aggregate=a.name, field=a.group)
            if a.date is not None:
                if a.date not in every:
                    raise DefinitionFault("unknown_date", aggregate=a.name, field=a.date)
                if every[a.date].type is not FieldType.TIMESTAMP:
                    raise DefinitionFault("non_temporal_date", aggregate=a.name, field=a.date)
            if a.metric == HISTOGRAM:
                if a.group is not None:
                    raise DefinitionFault("grouped_histogram", aggregate=a.name)
                if not a.bounds or len(a.bounds) > 63 or any(x >= y for x, y in zip(a.bounds, a.bounds[1:], strict=False)):
                    raise DefinitionFault("invalid_bounds", aggregate=a.name)
            if a.metric != COUNT and (a.field not in active or not active[a.field].type.numeric):
                raise DefinitionFault("non_numeric_metric", aggregate=a.name, field=a.field)
            if a.shards is not None and not 2 <= a.shards <= 64:
                raise DefinitionFault("invalid_shards", aggregate=a.name)

    def to_json(self) -> str:
        fields = [{k: (v.label if k == "type" else v) for k, v in asdict(f).items() if v is not None and v is not False} | {"type": f.type.label} for f in self.fields]
        aggregates = [{k: v for k, v in asdict(a).items() if v is not None} for a in self.aggregates]
        return json.dumps({"entity": self.name, "version": self.version, "fields": fields, "aggregates": aggregates}, indent=1, default=str)

    @staticmethod
    def from_json(text: str) -> Entity:
        raw = json.loads(text)
        fields = tuple(Field(**{**f, "type": FieldType.of(f["type"]), **({"allowed": tuple(f["allowed"])} if "allowed" in f else {})}) for f in raw["fields"])
        aggregates = tuple(Aggregate(**{**a, **({"bounds": tuple(a["bounds"])} if "bounds" in a else {})}) for a in raw["aggregates"])
        return Entity(raw["entity"], raw["version"], fields, aggregates)


def _overlap(a: Field, b: Field) -> bool:
    last = 1 << 30
    return max(a.since or 1, b.since or 1) < min(a.until or last, b.until or last)


class SchemaBuilder:
    """Declares an entity; create() publishes its first version, update() the next one."""

    def __init__(self, registry, entity: str):
        self.registry, self.entity = registry, entity
        self.fields: list[Field] = []
        self.aggregates: list[Aggregate] = []

    def field(self, name: str, kind: FieldType | str, **constraints) -> SchemaBuilder:
        if "allowed" in constraints:
            constraints["allowed"] = tuple(constraints["allowed"])
        self.fields.append(Field(name, FieldType.of(kind), **constraints))
        return self

    def _declare(self, **parts) -> SchemaBuilder:
        self.aggregates.append(Aggregate(**parts))
        return self

    def count(self, by: str | None = None, at: str | None = None, shards: int | None = None) -> SchemaBuilder:
        return self._declare(group=by, date=at, shards=shards)

    def sum(self, name: str, by: str | None = None, at: str | None = None, shards: int | None = None) -> SchemaBuilder:
        return self._declare(metric=SUM, field=name, group=by, date=at, shards=shards)

    def min(self, name: str, by: str | None = None, at: str | None = None) -> SchemaBuilder:
        return self._declare(metric=MIN, field=name, group=by, date=at)

    def max(self, name: str, by: str | None = None, at: str | None = None) -> SchemaBuilder:
        return self._declare(metric=MAX, field=name, group=by, date=at)

    def histogram(self, of: str, bounds: list[float], at: str | None = None) -> SchemaBuilder:
        return self._declare(metric=HISTOGRAM, field=of, bounds=tuple(float(b) for b in bounds), date=at)

    def create(self) -> Entity:
        """Version 1; every groupable field that nothing counts by gets a count, after the declared rollups."""
        taken = {a.name for a in self.aggregates}
        counts = [Aggregate(group=f.name) for f in self.fields if f.groupable and f"by_{f.name}" not in taken]
        return self.registry.publish(Entity(self.entity, 1, tuple(self.fields), (*self.aggregates, *counts)))

    def update(self) -> list[str]:
        """The next version; returns new groupable fields that nothing counts by.

        A field of the same name, type and storage goes on, and its bounds may only widen. Any other declaration opens a
        new field, and what is not declared again is closed. Rollups are inherited, replaced by those of the same name,
        and lapse with the field they group by or measure.
        """
        old = self.registry.definition(self.entity)
        version = old.version + 1
        fields: list[Field] = []
        carried = set()
        for new in self.fields:
            held = next((f for f in old.active_fields() if f.name == new.name), None)
            if held and held.type is new.type and held.payload == new.payload:
                if (new.min if new.min is not None else -float("inf")) > (held.min if held.min is not None else -float("inf")) or (new.max if new.max is not None else float("inf")) < (held.max if held.max is not None else float("inf")):
                    raise DefinitionFault("narrowed_bounds", field=new.name)
                fields.append(replace(new, since=held.since, until=held.until))
                carried.add(new.name)
            else:
                fields.append(replace(new, since=version))
        for f in old.fields:
            if f.name in carried and f.active(old.version):
                continue
            fields.append(replace(f, until=version) if f.active(old.version) and f.until is None else f)
        active = {f.name for f in fields if f.active(version)}
        named = {a.name: a for a in self.aggregates}
        before = {a.name for a in old.aggregates}
        merged = [replace(named[a.name], since=a.since) if a.name in named else a for a in old.aggregates]
        merged += [replace(a, since=version) for a in self.aggregates if a.name not in before]
        live = tuple(a for a in merged if all(x in active for x in (a.group, a.field) if x is not None))
        self.registry.publish(Entity(self.entity, version, tuple(fields), live))
        counted = {a.group for a in live}
        return [f.name for f in fields if f.since == version and f.groupable and f.name not in counted]

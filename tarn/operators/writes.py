"""What a batch of records does: defaults, checks, one entry per key, and the cells that its rollups gain and lose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.errors import SchemaError, ValueFault
from tarn.functions import from_value_json, whole_match
from tarn.operators import rollups
from tarn.schema import MAX, MIN, Aggregate, Entity, Field
from tarn.types import takes_column

UUID, VERSION, WRITTEN = "uuid", "_version", "_written"
#: A record with this set takes its key's record away.
GONE = "_gone"


def with_defaults(df: DataFrame, entity: Entity) -> DataFrame:
    """Every active field as a column of its type, under its physical name; omitted ones have their default, or are missing.

    A column that its field cannot hold whole (text or fractions for whole numbers, say) is refused, never cast.
    """
    given = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in entity.active_fields():
        if f.name in given and not takes_column(f.type, given[f.name]):
            raise SchemaError("type_mismatch", entity=entity.name, field=f.name)
        c = F.col(f"`{f.name}`") if f.name in given else F.lit(None)
        c = c.cast(f.type.spark)
        if f.default is not None:
            default = F.array(*[F.lit(v) for v in f.default]) if f.type.is_list else F.lit(int(f.default) if isinstance(f.default, bool) else f.default)
            c = F.coalesce(c, default.cast(f.type.spark))
        out.append(c.alias(f.column))
    known = {f.name for f in entity.active_fields()}
    extra = [c for c in df.columns if c not in known and c != UUID and not c.startswith("_")]
    if extra:
        raise SchemaError("unknown_field", entity=entity.name, field=extra[0])
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c == UUID or c.startswith("_")], *out)


def from_values(df: DataFrame, entity: Entity) -> DataFrame:
    """Records given as JSON values (as value_json() writes them), with defaults; _mistyped names the fields whose value is
    of another type than theirs."""
    active = {f.name: f for f in entity.active_fields() if f.name in df.columns}
    typed = {name: from_value_json(F.col(f"`{name}`"), f.type) for name, f in active.items()}
    wrong = [F.when(F.col(f"`{name}`").isNotNull() & c.isNull(), F.lit(name)) for name, c in typed.items()]
    rows = df.withColumn("_mistyped", F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>"))
    return with_defaults(rows.withColumns(typed), entity)


def _breaks(f: Field, typed: bool = True) -> list[tuple[str, Column]]:
    """A field's faults in the order in which they are looked for, each with the column that is true where it holds."""
    c = F.col(f"`{f.column}`")
    every = (lambda test: F.exists(c, lambda x: ~test(x))) if f.type.is_list else (lambda test: ~test(c))
    out = []
    mistyped = F.lit(False) if typed else F.array_contains("_mistyped", f.name)
    if f.required:
        out.append(("missing_field", c.isNull() & ~mistyped))
    if not typed:
        out.append(("type_mismatch", mistyped))
    if f.allowed is not None:
        out.append(("outside_domain", every(lambda x: x.isin(*f.allowed))))
    if f.pattern is not None:
        out.append(("pattern_mismatch", every(lambda x: whole_match(x, f.pattern))))
    if f.min is not None:
        out.append(("below_minimum", every(lambda x: x >= f.min)))
    if f.max is not None:
        out.append(("above_maximum", every(lambda x: x <= f.max)))
    return out


def fault(entity: Entity, typed: bool = True) -> Column:
    """The first fault of a record as 'code:field', null where there is none. Missing values break nothing but required."""
    tests = [F.when(broken, F.lit(f"{code}:{f.name}")) for f in entity.active_fields() for code, broken in _breaks(f, typed)]
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def violations(df: DataFrame, entity: Entity) -> DataFrame:
    """Records that break a constraint, with their first fault."""
    return df.withColumn("fault", fault(entity, "_mistyped" not in df.columns)).where("fault is not null")


def raise_first(df: DataFrame, entity: Entity) -> None:
    """Stops at a batch with any violation, before anything is written."""
    row = violations(df, entity).select("fault").first()
    if row:
        code, _, name = row["fault"].partition(":")
        raise SchemaError(code, field=name) if code in SchemaError.codes else ValueFault(code, field=name)


def one_per_key(df: DataFrame, position: str = "_position") -> DataFrame:
    """The last entry of each key, at the place of its first."""
    last = df.groupBy(UUID).agg(F.max(position).alias("_last"), F.min(position).alias("_first"))
    kept = df.join(last, UUID).where(F.col(position) == F.col("_last"))
    return kept.drop(position, "_last").withColumnRenamed("_first", position)


def replaced(current: DataFrame, batch: DataFrame) -> DataFrame:
    """current with the batch's records in place of those of their keys; records are replaced whole."""
    return current.join(batch.select(UUID), UUID, "left_anti").unionByName(batch, allowMissingColumns=True)


def _given(df: DataFrame, aggregates: list[Aggregate], entity: Entity, written: Column, sign: int) -> DataFrame:
    """(aggregate, grp, hour, value) that the records give to each rollup: one pass over them, whatever the rollups' number."""
    cells = [
        F.struct(F.lit(a.name).alias("aggregate"), rollups.group_key(a, entity).alias("grp"), rollups.cell_hour(a, entity, written).alias("hour"),
                 F.when(F.col(VERSION) >= a.since, rollups.measure(a, entity) * sign).alias("value"))
        for a in aggregates
    ]
    return df.select(F.inline(F.filter(F.array(*cells), lambda c: c["value"].isNotNull() & c["grp"].isNotNull())))


def gains(batch: DataFrame, previous: DataFrame, entity: Entity, written: Column) -> DataFrame:
    """(aggregate, grp, hour, value) that a batch adds to the entity's rollups, with one shuffle for all of them.

    Sums and counts lose what the records' previous versions had given, in the hour of this batch where the rollup has no
    date; what nets to zero adds no cell. Minima and maxima are running: they never give anything back. Versions from
    before the aggregate was declared take no part, on either side. A record that is gone gives nothing.
    """
    every = list(entity.aggregates)
    least, most = ([a.name for a in every if a.metric == m] or [""] for m in (MIN, MAX))
    summed = [a for a in every if a.metric not in (MIN, MAX)]
    cells = _given(batch.where(~F.col(GONE)) if GONE in batch.columns else batch, every, entity, written, 1)
    if summed:
        cells = cells.unionByName(_given(previous, summed, entity, written, -1))
    totals = cells.groupBy("aggregate", "grp", "hour").agg(F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))
    extreme = F.when(F.col("aggregate").isin(least), F.col("min")).when(F.col("aggregate").isin(most), F.col("max"))
    value = F.coalesce(extreme, F.when(F.col("sum") != 0, F.col("sum")))
    return totals.select("aggregate", "grp", "hour", value.alias("value")).where("value is not null")


def from_log(log: DataFrame, aggregate: Aggregate, entity: Entity, order: str = "_batch") -> DataFrame:
    """The rollup that the whole write log amounts to: one row per record and batch, with uuid, _written and _version.

    A window over a key sees that record's versions only.
    """
    names = [c for c in log.columns if c != UUID]
    was = Window.partitionBy(UUID).orderBy(order)
    both = log.withColumn("_old", F.lag(F.struct(*[F.col(f"`{c}`") for c in names])).over(was))
    new = rollups.contributions(log.where(F.col(VERSION) >= aggregate.since), aggregate, entity, F.col(WRITTEN))
    if aggregate.metric in (MIN, MAX):
        return new.groupBy("grp", "hour").agg(rollups.combine(aggregate).alias("value"))
    # a previous version is taken back in the hour of the batch that replaces it
    old = both.where("_old is not null").select(UUID, F.col(WRITTEN).alias("_now"), "_old.*")
    minus = rollups.contributions(old.where(F.col(VERSION) >= aggregate.since), aggregate, entity, F.col("_now"))
    return new.unionByName(minus.withColumn("value", -F.col("value"))).groupBy("grp", "hour").agg(F.sum("value").alias("value"))


def as_of_version(df: DataFrame, entity: Entity) -> DataFrame:
    """Records as their own version saw them: a field shows where the record's version lies within its window."""
    version = F.col(VERSION)
    newer = F.when(version > entity.version, F.raise_error(F.concat(F.lit(f"stale_schema: {entity.name} "), version.cast("string"))).cast("int"))
    out = [F.col(UUID), (version + F.coalesce(newer, F.lit(0))).cast("int").alias(VERSION)]
    names = dict.fromkeys(f.name for f in entity.fields)
    have = set(df.columns)
    for name in names:
        windows = [f for f in entity.fields if f.name == name and f.column in have]
        if not windows:
            continue
        kinds = {f.type for f in windows}
        shown = [F.when((version >= (f.since or 1)) & (version < (f.until or 1 << 30)), F.col(f"`{f.column}`").cast(f.type.spark if len(kinds) == 1 else "string")) for f in windows]
        out.append(reduce(lambda a, b: F.coalesce(a, b), shown).alias(name))
    return df.select(*out)

"""The store: entities, their records and rollups as tables under one folder.

    schema/                                              published definitions
    data/<entity>/commit=<n>-delta/records/              the records that one batch wrote or took away
    data/<entity>/commit=<n>-base/records/bucket=<b>/    all records up to a compaction; a key's bucket is a hash of it
    data/<entity>/commit=<n>-*/of=cells/aggregate=<a>/week=<w>/ cells that the batch gained or lost, or all of them

A batch writes its own records and cells and nothing else, and one rename makes both visible; a batch that fails leaves
nothing that is read. A batch of a named source counts once, however often it is written. Reads put the deltas over the
base: the base is scanned with its filters pushed down, less the keys of the deltas. compact() makes a new base, with
buckets in proportion to its rows; writing does so by itself where deltas have come to outweigh the base, so rewriting
costs a constant share of what was written. Readers of one aggregate open only its own folders, and a series only the
weeks that it covers.

A store has one writer at a time. Keys belong to their entity: the same key may be used in several.
"""

from __future__ import annotations

import datetime as dt
import uuid as ids
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.errors import SchemaError
from tarn.functions import salted, week_of
from tarn.operators import writes
from tarn.operators.writes import GONE, UUID, VERSION, WRITTEN
from tarn.plans.query import Query
from tarn.registry import Registry
from tarn.schema import Aggregate, Entity, SchemaBuilder
from tarn.session import prepare
from tarn.sources.commits import BASE, DELTA, Commit, Commits, Files, joined
from tarn.types import takes

BUCKETS, ROWS_IN_BUCKET = 64, 4_000_000
#: So many deltas, with half as many rows as the base at least, become a new base.
DELTAS = 8
CELLS = "grp string, hour timestamp, value double"


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = prepare(spark), path.rstrip("/"), buckets
        self.registry = Registry(spark, f"{self.path}/schema")
        self.files = Files(spark)

    def schema(self, entity: str) -> SchemaBuilder:
        return self.registry.schema(entity)

    def describe(self, entity: str) -> dict:
        return self.registry.describe(entity)

    # reading

    def query(self, entity: str) -> Query:
        definition = self.registry.definition(entity)
        return Query(definition, self._stored(definition), lambda a: self.cells(definition, a))

    def records(self, entity: str) -> DataFrame:
        """All records, each as its own version of the schema saw it."""
        definition = self.registry.definition(entity)
        return writes.as_of_version(self._stored(definition), definition)

    def fetch(self, entity: str, keys: list[str]) -> DataFrame:
        """Records by key, in the order of their keys; keys without one are left out."""
        definition = self.registry.definition(entity)
        rows = self._stored(definition, keys).where(F.col(UUID).isin(list(keys)))
        return writes.as_of_version(rows, definition).orderBy(UUID)

    def fetch_in_order(self, entity: str, keys: list[str]) -> DataFrame:
        """Records by key, in the order asked; keys without one are left out, a key asked for twice comes twice."""
        places = self.spark.createDataFrame(list(enumerate(keys)), f"_place long, {UUID} string")
        found = self.fetch(entity, list(dict.fromkeys(keys)))
        return places.join(found, UUID).orderBy("_place").select(found.columns)

    def find(self, key: str) -> tuple[str, Row] | None:
        """The entity and record of a key, whichever entity has it (the first by name): one job for all of them."""
        held = [self._stored(self.registry.definition(e), [key]).where(F.col(UUID) == key).select(F.lit(e).alias("entity")) for e in self.entities()]
        owner = reduce(DataFrame.unionByName, held).agg(F.min("entity")).first()[0] if held else None
        return (owner, self.fetch(owner, [key]).first()) if owner else None

    def entities(self) -> list[str]:
        if not self.files.exists(f"{self.path}/schema"):
            return []
        return sorted(r[0] for r in self.spark.read.parquet(f"{self.path}/schema").select("entity").distinct().collect())

    def cells(self, entity: Entity, aggregate: Aggregate) -> DataFrame:
        """The rollup of an aggregate, over all commits, with the week by which a series narrows its folders."""
        return self._cells(entity).where(F.col("aggregate") == aggregate.name).select("grp", "hour", "value", "week")

    def _cells(self, entity: Entity) -> DataFrame:
        root, schema = self._root(entity.name), f"{CELLS}, aggregate string, week date"
        paths = [f"{c.path}/of=cells" for c in self._commits(entity.name).live() if self.files.exists(f"{c.path}/of=cells")]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", root).parquet(*paths)

    # writing

    def write(self, entity: str, rows: DataFrame | list[dict], now: dt.datetime | None = None, batch: int | None = None, source: str = "", deleting: list[str] | None = None) -> list[str] | None:
        """Checks, upserts and folds in a batch. Rows without a uuid get one; the last of several of one key wins.

        Returns the keys of a list, each once, in the order of their first rows (None for a DataFrame). An empty batch does
        nothing. batch: a number of the caller's own, within source, that makes a repeated write count once. deleting: keys
        whose records go in the same commit; sums and counts give back what these had given.
        """
        definition = self.registry.definition(entity)
        written = now or dt.datetime.now(dt.timezone.utc)
        keys = None
        if isinstance(rows, list):
            if not rows and not deleting:
                return []
            rows = [{UUID: str(ids.uuid4())} | {k: v for k, v in r.items() if k != UUID or v is not None} for r in rows]
            keys = list(dict.fromkeys(r[UUID] for r in rows))
            rows = self._frame(definition, rows)
        elif UUID not in rows.columns:
            rows = rows.withColumn(UUID, F.expr("uuid()"))
        if "_position" not in rows.columns:
            rows = rows.withColumn("_position", F.monotonically_increasing_id())
        commits = self._commits(entity)
        if batch is not None and commits.holds(source, batch):
            return keys
        full = writes.with_defaults(rows, definition)
        aside = f"{self.path}/incoming/{ids.uuid4().hex}"
        try:
            full.write.parquet(aside)  # once, so keys and positions do not change between the steps below
            full = self.spark.read.schema(full.schema).parquet(aside)
            writes.raise_first(full, definition)
            entries = writes.one_per_key(full).drop("_position").withColumn(GONE, F.lit(False))
            if deleting:
                gone = self.spark.createDataFrame([(k,) for k in dict.fromkeys(deleting)], f"{UUID} string").join(entries.select(UUID), UUID, "left_anti")
                entries = entries.unionByName(gone.withColumn(GONE, F.lit(True)), allowMissingColumns=True)
            entries = entries.withColumns({VERSION: F.lit(definition.version), WRITTEN: F.lit(written).cast("timestamp")})
            if entries.isEmpty():
                return keys
            about = {"rows": full.count(), "batches": {source: [[batch, batch]]} if batch is not None else {}}
            commits.commit(DELTA, about, lambda folder: self._write_delta(definition, entries, written, folder))
        finally:
            self.files.delete(aside)
        self._settle(definition, commits)
        return keys

    def delete(self, entity: str, keys: list[str], now: dt.datetime | None = None) -> None:
        """Takes records away by key; keys without one do nothing."""
        self.write(entity, [], now=now, deleting=list(keys))

    def _write_delta(self, definition: Entity, entries: DataFrame, written: dt.datetime, folder: str) -> None:
        columns = [UUID, GONE, VERSION, WRITTEN, *[f.column for f in definition.active_fields()]]
        entries.select(*[F.col(f"`{c}`") for c in columns]).write.parquet(f"{folder}/records")
        entries = self.spark.read.parquet(f"{folder}/records")
        if definition.aggregates:
            previous = self._stored(definition).join(entries.select(UUID), UUID, "left_semi")
            self._write_cells(definition, writes.gains(entries, previous, definition, F.lit(written).cast("timestamp")), f"{folder}/of=cells")

    @staticmethod
    def _write_cells(definition: Entity, cells: DataFrame, folder: str) -> None:
        """An aggregate's week is one file, or as many as it declares shards: groups are dealt over them by hash."""
        shards = {a.name: a.shards for a in definition.aggregates if a.shards}
        parts = F.lit(1)
        for name, n in shards.items():
            parts = F.when(F.col("aggregate") == name, n).otherwise(parts)
        cells = cells.withColumn("week", F.to_date(week_of(F.col("hour")))).withColumn("_shard", F.pmod(F.xxhash64("grp"), parts))
        cells.repartition("aggregate", "week", "_shard").drop("_shard").write.partitionBy("aggregate", "week").parquet(folder)

    def compact(self, entity: str) -> None:
        """One base in place of all commits. What the base before it had replaced is deleted only now, so a reader that began
        before a compaction ends on its own files. A crash at any point leaves either the old commits or the new base."""
        definition = self.registry.definition(entity)
        commits = self._commits(entity)
        live = commits.live()
        if not live:
            return
        merged = self._stored(definition)
        rows = merged.count()
        buckets = max(self.buckets, -(-rows // ROWS_IN_BUCKET))
        known = {a.name: a for a in definition.aggregates}
        cells = self._cells(definition).where(F.col("aggregate").isin(list(known) or [""])).groupBy("aggregate", "grp", "hour")
        kinds = {name: [n for n, a in known.items() if a.storage == name] or [""] for name in ("min", "max")}
        value = F.when(F.col("aggregate").isin(kinds["min"]), F.min("value")).when(F.col("aggregate").isin(kinds["max"]), F.max("value")).otherwise(F.sum("value"))
        cells = cells.agg(value.alias("value"))
        batches: dict[str, list[list[int]]] = {}
        for c in live:
            for source, ranges in commits.about(c).get("batches", {}).items():
                batches[source] = joined([*batches.get(source, []), *ranges])

        def fill(folder: str) -> None:
            merged.withColumn("bucket", salted(F.col(UUID), buckets)).repartition(max(1, buckets), "bucket").write.partitionBy("bucket").parquet(f"{folder}/records")
            if known:
                self._write_cells(definition, cells, f"{folder}/of=cells")

        commits.commit(BASE, {"rows": rows, "buckets": buckets, "batches": batches}, fill)
        for old in commits.every():
            if old.number < live[0].number:
                self.files.delete(old.path)

    def _settle(self, definition: Entity, commits: Commits) -> None:
        live = commits.live()
        deltas = [c for c in live if c.kind == DELTA]
        if len(deltas) >= DELTAS:
            about = {c: commits.about(c).get("rows", 0) for c in live}
            if 2 * sum(about[c] for c in deltas) >= sum(about[c] for c in live if c.kind == BASE):
                self.compact(definition.name)

    # files

    def _root(self, entity: str) -> str:
        return f"{self.path}/data/{entity}"

    def _commits(self, entity: str) -> Commits:
        return Commits(self.files, self._root(entity))

    def _schema(self, definition: Entity) -> T.StructType:
        fields = [T.StructField(UUID, T.StringType()), T.StructField(VERSION, T.IntegerType()), T.StructField(WRITTEN, T.TimestampType())]
        return T.StructType(fields + [T.StructField(f.column, f.type.spark) for f in definition.fields])

    def _stored(self, definition: Entity, keys: list[str] | None = None) -> DataFrame:
        """Current records under physical names; columns of fields that a file does not know are missing. keys: of which
        buckets alone to read the base."""
        schema, commits = self._schema(definition), self._commits(definition.name)
        live = commits.live()
        deltas = [c for c in live if c.kind == DELTA]
        base = next((self._base(c, schema, commits, keys) for c in live if c.kind == BASE), None)
        if not deltas:
            return self.spark.createDataFrame([], schema) if base is None else base
        changed = [self._delta(c, schema) for c in deltas]
        last = changed[0]
        if len(deltas) > 1:
            # of the versions of a key that the deltas hold, the last one
            held = reduce(DataFrame.unionByName, changed)
            order = Window.partitionBy(UUID).orderBy(F.col("_commit").desc())
            last = held.withColumn("_turn", F.row_number().over(order)).where("_turn = 1").drop("_turn")
        here = last.where(~F.col(GONE)).drop(GONE, "_commit")
        if base is None:
            return here
        touched = reduce(DataFrame.unionByName, [c.select(UUID) for c in changed])
        return base.join(touched, UUID, "left_anti").select(*[F.col(f"`{c}`") for c in schema.names]).unionByName(here)

    def _base(self, commit: Commit, schema: T.StructType, commits: Commits, keys: list[str] | None) -> DataFrame:
        with_bucket = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
        rows = self.spark.read.schema(with_bucket).parquet(f"{commit.path}/records")
        if keys is not None:
            buckets = commits.about(commit)["buckets"]
            # literals, so Spark folds the hashes and prunes the folders
            rows = rows.where(F.col("bucket").isin(*[salted(F.lit(k), buckets) for k in dict.fromkeys(keys)]) if keys else F.lit(False))
        return rows.drop("bucket")

    def _delta(self, commit: Commit, schema: T.StructType) -> DataFrame:
        with_gone = T.StructType([*schema.fields, T.StructField(GONE, T.BooleanType())])
        return self.spark.read.schema(with_gone).parquet(f"{commit.path}/records").withColumn("_commit", F.lit(commit.number))

    def _frame(self, definition: Entity, rows: list[dict]) -> DataFrame:
        known = {f.name: f.type for f in definition.active_fields()}
        names = list(dict.fromkeys([UUID, *(k for r in rows for k in r)]))
        for n in names:
            if n != UUID and n not in known:
                raise SchemaError("unknown_field", entity=definition.name, field=n)
        for r in rows:
            for n, v in r.items():
                if n != UUID and v is not None and not takes(known[n], v):
                    raise SchemaError("type_mismatch", entity=definition.name, field=n)
        schema = T.StructType([T.StructField(n, known[n].spark if n in known else T.StringType()) for n in names] + [T.StructField("_position", T.LongType())])
        data = [tuple(self._value(r.get(n), known.get(n)) for n in names) + (i,) for i, r in enumerate(rows)]
        return self.spark.createDataFrame(data, schema)

    @staticmethod
    def _value(v, kind):
        """As Spark wants it; a whole number beyond what a column holds is refused by Spark itself."""
        if v is None or kind is None:
            return v
        if kind.is_list:
            return [Store._value(x, kind.element) for x in v]
        if kind.label == "timestamp" and not isinstance(v, dt.datetime):
            return dt.datetime(v.year, v.month, v.day, tzinfo=dt.timezone.utc)
        return float(v) if kind.label == "double" else int(v) if kind.label == "int" else v

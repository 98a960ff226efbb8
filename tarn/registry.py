"""The catalog of published definitions: one JSON row per version, in memory or in a table of the shared store."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tarn.errors import SchemaError
from tarn.schema import Entity, SchemaBuilder


class Registry:
    """Latest versions win and are validated when published and when read. path: where to keep them, if anywhere."""

    def __init__(self, spark: SparkSession | None = None, path: str | None = None):
        self.spark, self.path = spark, path
        self.held: dict[str, Entity] = {}

    def schema(self, entity: str) -> SchemaBuilder:
        return SchemaBuilder(self, entity)

    def publish(self, definition: Entity) -> Entity:
        definition.validate()
        if self.path:
            row = [(definition.name, definition.version, definition.to_json())]
            self.spark.createDataFrame(row, "entity string, version int, definition string").coalesce(1).write.mode("append").parquet(self.path)
        self.held[definition.name] = definition
        return definition

    def definition(self, entity: str) -> Entity:
        if entity not in self.held:
            self.held[entity] = self._load(entity)
        return self.held[entity]

    def _load(self, entity: str) -> Entity:
        rows = []
        if self.path:
            fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            if fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs):
                rows = self.spark.read.parquet(self.path).where(F.col("entity") == F.lit(entity)).orderBy("version", ascending=False).limit(1).collect()
        if not rows:
            raise SchemaError("unknown_entity", entity=entity)
        return Entity.from_json(rows[0]["definition"]).validate()

    def describe(self, entity: str) -> dict:
        """Names, types and constraints of the fields that the current version has, and its rollups' names."""
        d = self.definition(entity)
        return {"entity": d.name, "version": d.version, "fields": {f.name: f.type.label for f in d.active_fields()}, "aggregates": [a.name for a in d.aggregates]}


def migrate(store, steps: list) -> None:
    """Runs prepare(store) of each step in order."""
    for step in steps:
        step.prepare(store)


def revert(store, steps: list) -> None:
    """Runs revert(store) of each step in reverse order."""
    for step in reversed(steps):
        step.revert(store)

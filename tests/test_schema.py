import pytest

from tarn.errors import DefinitionFault, SchemaError
from tarn.registry import Registry
from tarn.schema import Aggregate, Entity, Field
from tarn.types import FieldType

S, T, I, D, TS = FieldType.STRING, FieldType.TEXT, FieldType.INT, FieldType.DOUBLE, FieldType.TIMESTAMP


def refused(code, fields=(), aggregates=(), name="thing"):
    with pytest.raises(DefinitionFault) as error:
        Entity(name, 1, tuple(fields), tuple(aggregates)).validate()
    assert error.value.code == code


def test_each_definition_fault():
    refused("reserved_entity", name="__schema")
    refused("exhausted_pool", [Field(f"s{i}", S) for i in range(32)])
    refused("exhausted_payload", [Field(f"p{i}", I, payload=True) for i in range(17)])
    refused("unsupported_pattern", [Field("n", I, pattern="a")])
    refused("malformed_pattern", [Field("n", S, pattern="(")])
    refused("unsupported_allowed", [Field("n", I, allowed=("a",))])
    refused("unsupported_bounds", [Field("n", S, min=1)])
    refused("shared_slot", [Field("n", S), Field("n", I)])
    refused("duplicate_aggregate", [Field("n", I)], [Aggregate(group="n"), Aggregate(group="n")])
    refused("unknown_grouping", [], [Aggregate(group="n")])
    refused("unknown_date", [], [Aggregate(date="n")])
    refused("non_temporal_date", [Field("n", I)], [Aggregate(date="n")])
    refused("grouped_histogram", [Field("n", D)], [Aggregate("histogram", "n", group="n", bounds=(1.0,))])
    refused("invalid_bounds", [Field("n", D)], [Aggregate("histogram", "n", bounds=(2.0, 1.0))])
    refused("invalid_bounds", [Field("n", D)], [Aggregate("histogram", "n", bounds=())])
    refused("non_numeric_metric", [Field("n", S)], [Aggregate("sum", "n")])
    refused("invalid_shards", [Field("n", D)], [Aggregate(shards=65)])


def test_automatic_counts_follow_declared_rollups():
    r = Registry()
    made = r.schema("p").field("id", S).field("n", I).field("a", D).field("at", TS).field("note", S, payload=True).field("x", S, ungrouped=True).count(by="n").sum("a", by="id", at="at").create()
    assert [a.name for a in made.aggregates] == ["by_n", "sum_a_by_id_at_at", "by_id", "by_a"]


def test_update_carries_closes_and_opens():
    r = Registry()
    r.schema("p").field("id", S).field("n", I, min=0, max=5).field("t", S).sum("n", by="t").create()
    new = r.schema("p").field("id", S).field("n", D).field("status", S).field("date", TS).update()
    d = r.definition("p")
    assert new == ["status"]  # the count by n goes on under its name
    assert d.version == 2
    assert {f.name: (f.since, f.until, f.column) for f in d.fields if f.active(2)} == {"id": (None, None, "id"), "n": (2, None, "n__v2"), "status": (2, None, "status__v2"), "date": (2, None, "date__v2")}
    assert {f.name for f in d.fields if f.until == 2} == {"n", "t"}
    # the sum of n by t lapsed with t, the counts by id and n stay: their fields' names are active
    assert [a.name for a in d.aggregates] == ["by_id", "by_n"]


def test_bounds_may_only_widen():
    r = Registry()
    r.schema("p").field("n", I, min=0, max=5).create()
    r.schema("p").field("n", I, min=-1, max=6).update()
    with pytest.raises(DefinitionFault) as error:
        r.schema("p").field("n", I, min=0, max=6).update()
    assert error.value.code == "narrowed_bounds"


def test_definitions_survive_json():
    d = Entity("p", 3, (Field("id", S, allowed=("a", "b"), since=2), Field("n", I, min=0, default=1)), (Aggregate("histogram", "n", bounds=(1.0, 2.0)),))
    assert Entity.from_json(d.to_json()) == d


def test_catalog_on_disk(spark, tmp_path):
    path = str(tmp_path / "schema")
    with pytest.raises(SchemaError):
        Registry(spark, path).definition("p")
    r = Registry(spark, path)
    r.schema("p").field("id", S).create()
    r.schema("p").field("id", S).field("n", I).update()
    assert Registry(spark, path).definition("p").version == 2
    assert Registry(spark, path).describe("p")["fields"] == {"id": "string", "n": "int"}
    with pytest.raises(SchemaError):
        Registry(spark, path).definition("q")

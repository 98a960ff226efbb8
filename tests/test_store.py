import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarn.errors import SchemaError, ValueFault
from tarn.operators import writes
from tarn.operators.filters import attr
from tarn.registry import migrate, revert
from tarn.sources.store import Store

NOON = dt.datetime(1970, 1, 1, 10, tzinfo=dt.timezone.utc)
WEEK = dt.timedelta(days=7)


def totals(df):
    return [(r["grp"], r["value"]) for r in df.collect()]


def test_upsert_replaces_whole_records_and_moves_cells(store):
    store.schema("payment").field("product", "string").field("amount", "double").field("note", "string", payload=True).field("date", "timestamp").sum("amount", by="product", at="date").sum("amount").min("amount").count(by="product", at="date").create()
    assert store.write("payment", []) == []
    assert store.query("payment").count() == 0 and store.query("payment").sum("amount") == 0 and store.query("payment").min("amount") is None
    keys = store.write("payment", [{"uuid": "p-1", "product": "app", "amount": 10, "note": "x", "date": NOON}, {"product": "pro", "amount": 5.0}, {"uuid": "p-1", "product": "app", "amount": 12, "date": NOON}], now=NOON)
    assert keys[0] == "p-1" and len(keys) == 2  # each key once, where its first row stood
    q = store.query("payment")
    assert (q.count(), q.sum("amount"), q.min("amount")) == (2, 17, 5)
    assert q.filter(attr("product") == "app").first()["note"] is None  # the last entry won, and it has no note
    store.write("payment", [{"uuid": "p-1", "product": "book", "amount": 40.0, "date": NOON + WEEK}])
    q = store.query("payment")
    assert (q.count(), q.sum("amount")) == (2, 45)
    assert q.min("amount") == 5
    # counts of nothing vanish, sums of nothing stay
    assert totals(q.totals(group="product")) == [("book", 1), ("pro", 1)]
    assert totals(q.totals("amount", "sum", "product")) == [("app", 0), ("book", 40), ("pro", 5)]
    store.compact("payment")
    assert totals(store.query("payment").totals("amount", "sum", "product")) == [("app", 0), ("book", 40), ("pro", 5)]


def test_extremes_run_and_sums_do_not(store):
    store.schema("meter").field("v", "double").min("v").max("v").sum("v").create()
    store.write("meter", [{"uuid": "u1", "v": 2}, {"uuid": "u2", "v": 8}])
    store.write("meter", [{"uuid": "u1", "v": 6}])
    q = store.query("meter")
    assert (q.min("v"), q.max("v"), q.sum("v")) == (2, 8, 14)


def test_a_batch_that_runs_again_counts_once(store):
    store.schema("m").field("v", "double").sum("v").count().create()
    for _ in range(2):
        store.write("m", [{"uuid": "a", "v": 3.0}], batch=7)
    assert store.query("m").sum("v") == 3 and store.query("m").count() == 1


def test_folds_read_the_rollup(store, spark):
    store.schema("crate").field("units", "int", required=True, min=1, max=20).create()
    store.write("crate", [{"units": u} for u in (1, 5, 12, 16, 20)])
    assert store.query("crate").filter(attr("units") > 15).count() == 2
    folder = f"{store.path}/data/crate/commit=000000000099-delta"
    store._stored(store.registry.definition("crate")).limit(0).withColumn("_gone", F.lit(False)).write.parquet(f"{folder}/records")
    spark.createDataFrame([("i16", NOON, 40.0)], "grp string, hour timestamp, value double").write.parquet(f"{folder}/of=cells/aggregate=by_units/week=1970-01-01")
    assert store.query("crate").filter(attr("units") > 15).count() == 42


def test_a_series_opens_the_weeks_in_range_only(store):
    store.schema("e").field("date", "timestamp").count(at="date").create()
    store.write("e", [{"date": NOON + i * WEEK} for i in range(6)])
    series = store.query("e").series(NOON.replace(tzinfo=None) + WEEK, NOON.replace(tzinfo=None) + 2 * WEEK + dt.timedelta(hours=1))
    assert [r["value"] for r in series.collect()] == [1, 1]
    plan = series._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "week" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_violations_stop_a_batch_before_it_is_written(store):
    store.schema("account").field("email", "string", pattern=r"[^@]+@[^@]+\.[a-z]+").field("codes", "stringList", pattern="[A-Z]{3}").field("n", "int", required=True, min=0, max=5).field("kind", "string", allowed=["a", "b"], default="a").create()
    good = {"uuid": "1", "email": "a@b.co", "codes": ["ABC"], "n": True}
    store.write("account", [good])
    row = store.fetch("account", ["1", "2"]).collect()
    assert [(r["n"], r["kind"]) for r in row] == [(1, "a")]
    for change, error, code in (
        ({"email": "a@b.co\n"}, ValueFault, "pattern_mismatch"), ({"codes": ["ABC", "ab"]}, ValueFault, "pattern_mismatch"), ({"n": None}, SchemaError, "missing_field"),
        ({"n": -1}, ValueFault, "below_minimum"), ({"n": 6}, ValueFault, "above_maximum"), ({"kind": "c"}, ValueFault, "outside_domain"), ({"x": 1}, SchemaError, "unknown_field"),
        ({"n": 1.7}, SchemaError, "type_mismatch"), ({"n": "1"}, SchemaError, "type_mismatch"), ({"email": 1}, SchemaError, "type_mismatch"), ({"codes": "ABC"}, SchemaError, "type_mismatch"), ({"codes": [1]}, SchemaError, "type_mismatch"),
    ):
        with pytest.raises(error) as found:
            store.write("account", [{**good, "uuid": "2"} | change])
        assert found.value.code == code
    assert store.records("account").count() == 1


def test_versions(store):
    store.schema("purchase").field("product", "string").field("amount", "int").create()
    store.write("purchase", [{"uuid": "old", "product": "a", "amount": 3}])
    store.schema("purchase").field("product", "string").field("amount", "double").field("total", "double").sum("total").update()
    store.write("purchase", [{"uuid": "new", "product": "b", "amount": 2.5, "total": 9.0}])
    rows = {r["uuid"]: r.asDict() for r in store.records("purchase").collect()}
    assert rows["old"]["amount"] == "3" and rows["old"]["total"] is None and rows["new"]["amount"] == "2.5"
    # filters name the current field: an old record answers only through fields that did not move
    found = lambda e: sorted(r["uuid"] for r in store.query("purchase").filter(e).frame().collect())
    assert found(attr("amount") > 0) == ["new"] and found(attr("product").isin(["a", "b"])) == ["new", "old"]
    # a rollup added later counts later writes only, and gives back only what it counted
    assert store.query("purchase").sum("total") == 9
    store.write("purchase", [{"uuid": "old", "product": "a", "amount": 1.0, "total": 1.0}])
    assert store.query("purchase").sum("total") == 10


def test_records_newer_than_the_definition_are_refused(store):
    store.schema("e").field("n", "int").create()
    store.write("e", [{"uuid": "1", "n": 1}])
    definition = store.registry.definition("e")
    newer = store._stored(definition).withColumn("_version", F.lit(2))
    with pytest.raises(Exception, match="stale_schema"):
        writes.as_of_version(newer, definition).collect()


def test_find_and_migrations(store):
    class Step:
        log = []

        def __init__(self, name):
            self.name = name

        def prepare(self, s):
            self.log.append(f"+{self.name}")
            s.schema(self.name).field("n", "int").create()

        def revert(self, s):
            self.log.append(f"-{self.name}")

    steps = [Step("a"), Step("b")]
    migrate(store, steps)
    revert(store, steps)
    assert Step.log == ["+a", "+b", "-b", "-a"]
    store.write("b", [{"uuid": "k", "n": 1}])
    assert store.entities() == ["a", "b"]
    assert store.find("k")[0] == "b" and store.find("q") is None
    with pytest.raises(SchemaError):
        store.query("c")


def test_the_log_gives_what_batches_gave(store, spark):
    entity = store.schema("p").field("g", "string").field("v", "double").field("at", "timestamp").sum("v", by="g").count(by="g", at="at").max("v", by="g").create()
    batches = [
        [{"uuid": "1", "g": "a", "v": 1.0, "at": NOON}, {"uuid": "2", "g": "a", "v": 2.0}, {"uuid": "3", "v": 9.0}],
        [{"uuid": "1", "g": "b", "v": 5.0}, {"uuid": "3", "v": 1.0}],
        [{"uuid": "1", "g": "a", "v": 1.0, "at": NOON}, {"uuid": "4", "g": "c"}],
    ]
    log = None
    for i, rows in enumerate(batches):
        now = NOON + dt.timedelta(hours=i)
        store.write("p", rows, now=now)
        full = writes.with_defaults(store._frame(entity, rows), entity).withColumn("_version", F.lit(1)).withColumn("_written", F.lit(now).cast("timestamp")).withColumn("_batch", F.lit(i)).drop("_position")
        log = full if log is None else log.unionByName(full)
    for a in entity.aggregates:
        fold = lambda df: sorted((r["grp"], r["hour"], r["value"]) for r in df.groupBy("grp", "hour").agg((F.max if a.metric == "max" else F.sum)("value").alias("value")).where("value <> 0").collect())  # noqa: B023, E731
        assert fold(store.cells(entity, a)) == fold(writes.from_log(log, a, entity)), a.name


def test_columns_that_a_field_cannot_hold_are_refused(store, spark):
    store.schema("m").field("n", "int").field("x", "double").field("t", "text").field("at", "timestamp").field("l", "doubleList").create()
    spark_rows = lambda kinds, row: spark.createDataFrame([("k", *row)], f"uuid string, {kinds}")
    for kinds, row in (("n double", (1.7,)), ("n string", ("1",)), ("n decimal(5,0)", (None,)), ("x bigint", (1,)), ("x string", ("1",)), ("t bigint", (1,)), ("at string", ("2024-01-01",)), ("l array<string>", (["1"],)), ("l double", (1.0,))):
        with pytest.raises(SchemaError) as found:
            store.write("m", spark_rows(kinds, row))
        assert found.value.code == "type_mismatch", kinds
    store.write("m", spark_rows("n int, x float, t string, at date, l array<float>", (1, 0.5, "a", dt.date(2024, 1, 1), [0.25])))
    store.write("m", spark_rows("n smallint, x int", (2, 3)).withColumn("t", F.lit(None)).withColumn("uuid", F.lit("j")))
    rows = {r["uuid"]: r for r in store.records("m").collect()}
    assert (rows["k"]["n"], rows["k"]["x"], rows["k"]["l"], rows["j"]["n"], rows["j"]["x"]) == (1, 0.5, [0.25], 2, 3.0)


DOUBLES = [0.0001, 1e-5, 12345678.9, 1e16, -2.5, 0.1, 1 / 3, 2.0**53, 2.0**53 + 2, 5e-5, 123456.0, 1e300]


def test_folds_over_groups_of_doubles(store):
    store.schema("p").field("price", "double").create()
    store.write("p", [{"price": x} for x in DOUBLES] * 2)
    assert [store.query("p").filter(attr("price") == x).count() for x in DOUBLES] == [2] * len(DOUBLES)
    assert store.query("p").filter(attr("price").isin([1e16, 0.0001, 7.5])).count() == 4
    keys = {g for g, _ in totals(store.query("p").totals(group="price"))}
    assert {"d0.0001", "d1e-05", "d12345678.9", "d1e+16", "d-2.5", "d9007199254740992.0", "d9.007199254740994e+15", "d123456.0"} <= keys
    assert totals(store.query("p").filter(attr("price") == 1e16).totals(group="price")) == [("d1e+16", 2)]


def test_deleted_records_give_back_what_they_counted(store):
    store.schema("d").field("g", "string").field("v", "double").sum("v", by="g").min("v").create()
    store.write("d", [{"uuid": str(i), "g": "a" if i < 3 else "b", "v": float(i)} for i in range(6)])
    store.write("d", [{"uuid": "9", "g": "b", "v": 10.0}], deleting=["0", "4", "none"])
    q = store.query("d")
    assert sorted(r["uuid"] for r in q.frame().collect()) == ["1", "2", "3", "5", "9"]
    assert q.filter(attr("g") == "a").count() == 2 and totals(q.totals("v", "sum", "g")) == [("a", 3), ("b", 18)] and q.min("v") == 0
    store.compact("d")
    store.delete("d", ["9", "9"])
    store.write("d", [{"uuid": "4", "g": "a", "v": 1.0}])
    q = store.query("d")
    assert sorted(r["uuid"] for r in q.frame().collect()) == ["1", "2", "3", "4", "5"] and totals(q.totals("v", "sum", "g")) == [("a", 4), ("b", 8)]
    assert [r["uuid"] for r in store.fetch_in_order("d", ["5", "9", "1", "4", "5"]).collect()] == ["5", "1", "4", "5"]
    assert [r["uuid"] for r in store.fetch("d", ["5", "9", "1", "4", "5"]).collect()] == ["1", "4", "5"] and store.fetch_in_order("d", []).count() == 0


def test_nothing_half_written_is_read(store, monkeypatch):
    store.schema("m").field("v", "double").sum("v").count().create()
    store.write("m", [{"uuid": "a", "v": 3.0}], batch=1)
    # a commit that stops on its way: records written, cells not
    with monkeypatch.context() as broken:
        broken.setattr(Store, "_write_cells", staticmethod(lambda *a: 1 / 0))
        with pytest.raises(ZeroDivisionError):
            store.write("m", [{"uuid": "a", "v": 9.0}, {"uuid": "b", "v": 1.0}], batch=2)
        with pytest.raises(ZeroDivisionError):
            store.compact("m")
    store.files.write_text(f"{store.path}/data/m/aside=left/records/_temporary/0/part-0", "x")
    assert (store.query("m").count(), store.query("m").sum("v")) == (1, 3)
    assert store.write("m", [{"uuid": "a", "v": 9.0}, {"uuid": "b", "v": 1.0}], batch=2) == ["a", "b"]
    assert (store.query("m").count(), store.query("m").sum("v")) == (2, 10)
    store.compact("m")
    # what a compaction that stopped before it deleted anything leaves: all old commits beside the new base
    assert [c.kind for c in store._commits("m").every()] == ["delta", "delta", "base"]
    for _ in range(2):
        store.write("m", [{"uuid": "a", "v": 9.0}, {"uuid": "b", "v": 1.0}], batch=2)
        store.write("m", [{"uuid": "a", "v": 3.0}], batch=1)
    assert (store.query("m").count(), store.query("m").sum("v")) == (2, 10)
    store.compact("m")
    assert [c.kind for c in store._commits("m").every()] == ["base", "base"] and store.files.names(f"{store.path}/incoming") == []
    assert (store.query("m").count(), store.query("m").sum("v")) == (2, 10)


def test_many_small_batches_become_a_base(store, monkeypatch):
    monkeypatch.setattr("tarn.sources.store.DELTAS", 3)
    store.schema("m").field("v", "int").sum("v").count().create()
    for i in range(7):
        store.write("m", [{"uuid": str(i % 4), "v": i}], batch=i, source="s")
    kinds = [c.kind for c in store._commits("m").live()]
    assert kinds[0] == "base" and len(kinds) <= 3
    assert (store.query("m").count(), store.query("m").sum("v")) == (4, 3 + 4 + 5 + 6)
    plan = store.fetch("m", ["1"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_names_with_quotes(store):
    store.schema("it's").field("n", "int").create()
    store.registry.held.clear()
    store.write("it's", [{"uuid": "q'k", "n": 1}])
    assert store.query("it's").count() == 1 and store.find("q'k")[0] == "it's"


def test_a_week_is_dealt_over_the_shards_that_its_rollup_declares(store, spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    store.schema("m").field("g", "string").count(by="g", shards=4).sum("n", by="g").field("n", "int").create()
    store.write("m", [{"g": str(i), "n": 1} for i in range(60)], now=NOON)
    folder = f"{store._commits('m').live()[0].path}/of=cells"
    files = {a: len([n for n in store.files.names(f"{folder}/aggregate={a}/week=1969-12-29") if n.startswith("part-")]) for a in ("by_g", "sum_n_by_g")}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files["by_g"] > 1 == files["sum_n_by_g"] and store.query("m").count() == 60

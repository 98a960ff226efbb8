import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarn.errors import QueryFault, SchemaError
from tarn.functions import bucket, canonical, digest, from_value_json, hour_of_week, value_json
from tarn.operators.filters import Filter, attr
from tarn.plans.query import Cursor, over
from tarn.registry import Registry
from tarn.types import FieldType

NOON = dt.datetime(1970, 1, 1, 10)


def table(spark, declare, rows, schema, key="uuid"):
    r = Registry()
    declare(r.schema("t")).create()
    return over(r.definition("t"), spark.createDataFrame(rows, schema), key)


@pytest.fixture(scope="module")
def purchases(spark):
    rows = [("p-0", "sku-0", 3, 30.0), ("p-1", "sku-1", 1, 10.0), ("p-2", "sku-2", 2, 20.0)]
    declare = lambda s: s.field("product", "string", required=True).field("quantity", "int", required=True, min=0, max=10).field("amount", "double").sum("quantity").sum("quantity", by="product").sum("amount", by="quantity").min("quantity").max("amount")
    return table(spark, declare, rows, "uuid string, product string, quantity long, amount double")


def uuids(q):
    return [r["uuid"] for r in q.frame().collect()]


def test_filter_sort_take(purchases):
    q = purchases.filter(attr("quantity") > 1).sort("quantity", reverse=True)
    assert [r["uuid"] for r in q.take(1)] == ["p-0"]
    either = (attr("quantity") > 0) & ((attr("product") == "sku-0") | ((attr("quantity") > 1) & (attr("amount") < 25)))
    assert uuids(purchases.filter(either).sort("product")) == ["p-0", "p-2"]
    assert purchases.sort("quantity").first()["uuid"] == "p-1"
    assert purchases.filter("quantity", "==", 99).first() is None


def test_pages(purchases):
    rows, cursor = purchases.sort("quantity").page(2)
    assert [r["uuid"] for r in rows] == ["p-1", "p-2"]
    rows, end = purchases.sort("quantity").page(2, cursor.encode())
    assert [r["uuid"] for r in rows] == ["p-0"] and end is None
    rows, cursor = purchases.sort("quantity", reverse=True).page(3)
    assert cursor == Cursor(1, "p-1")
    assert purchases.sort("quantity", reverse=True).page(3, cursor) == ([], None)


def test_ties_are_served_once(spark):
    rows = [(f"u{i:02}", 7) for i in range(25)]
    q = table(spark, lambda s: s.field("n", "int"), rows, "uuid string, n long").sort("n")
    seen, cursor = [], None
    while True:
        page, cursor = q.page(10, cursor)
        seen += [r["uuid"] for r in page]
        if cursor is None:
            break
    assert seen == [r[0] for r in rows]


def test_missing_sorts_first_and_is_on_no_page(spark):
    q = table(spark, lambda s: s.field("rank", "int"), [("n-1", 2), ("n-2", None), ("n-3", 1)], "uuid string, rank long")
    assert uuids(q.sort("rank")) == ["n-2", "n-3", "n-1"]
    assert uuids(q.sort("rank", reverse=True)) == ["n-1", "n-3", "n-2"]
    assert [r["uuid"] for r in q.sort("rank").page(9)[0]] == ["n-3", "n-1"]


def test_missing_never_matches(spark):
    q = table(spark, lambda s: s.field("score", "int").field("tags", "stringList"), [("u-1", 10, ["red", "db"]), ("u-2", 5, ["db"]), ("u-3", None, None)], "uuid string, score long, tags array<string>")
    found = lambda e: uuids(q.filter(e).sort("score"))
    assert found(attr("score") != 10) == ["u-2"]
    assert found(attr("score").notin([10])) == ["u-2"]
    assert found(attr("score").notin([])) == ["u-2", "u-1"]
    assert found(attr("score") > 4) == ["u-2", "u-1"]
    assert found(attr("score").isin([])) == []
    assert found(attr("tags").contains("red")) == ["u-1"]
    assert found(attr("tags") == ["db"]) == ["u-2"]
    assert found(attr("score") == "10") == []
    assert found(attr("score") == 10.0) == ["u-1"]


def test_search(spark):
    declare = lambda s: s.field("title", "string").field("body", "text")
    q = table(spark, declare, [("n-1", "a", "The quick brown fox"), ("n-2", "b", "Lazy dog sleeps"), ("n-3", "c", None)], "uuid string, title string, body string")
    found = lambda words: uuids(q.filter(attr("body").search(words)).sort("title"))
    assert found("brown") == ["n-1"] and found("brow") == [] and found("fox QUICK") == ["n-1"]
    assert found(" ,") == ["n-1", "n-2"]
    with pytest.raises(QueryFault) as error:
        q.filter(attr("title").search("a")).frame()
    assert error.value.code == "unsearchable_field"


def test_or_of_equalities_is_one_in():
    assert ((attr("a") == 1) | (attr("a") == 2) | attr("a").isin([2, 3])).alternatives == ((Filter("a", "in", (1, 2, 3)),),)
    assert len(((attr("a") == 1) | (attr("a") == "x")).alternatives) == 2
    assert len(((attr("a") == 1) | (attr("b") == 1)).alternatives) == 2


def test_scalar_folds(purchases):
    assert purchases.count() == 3 and purchases.limit(2).count() == 2
    assert purchases.sum("quantity") == 6 and purchases.min("quantity") == 1 and purchases.max("amount") == 30
    assert purchases.average("quantity") == 2
    assert purchases.filter(attr("quantity") > 1).sum("amount") == 50
    assert purchases.filter((attr("product") == "sku-0") | (attr("product") == "sku-2")).sum("quantity") == 5
    none = purchases.filter(attr("product") == "sku-9")
    assert none.sum("quantity") == 0 and none.average("quantity") is None and none.count() == 0


def test_ranges_become_keys(spark):
    declare = lambda s: s.field("units", "int", required=True, min=1, max=20).field("weight", "int", required=True, ungrouped=True)
    q = table(spark, declare, [(str(u), u, u) for u in (1, 5, 12, 16, 20)], "uuid string, units long, weight long")
    n = lambda e: q.filter(e).count()
    units = attr("units")
    assert (n(units > 15), n(units < 16), n(units <= 12), n(units >= 21)) == (2, 3, 3, 0)
    assert n((units >= 5) & (units < 16)) == 2
    refused = [attr("weight") > 3, (units == 1) & (units > 0), units != 1, (units == 1) & (units == 1), (units == 1) | (attr("weight") == 1), (units > 1) | (units < 0)]
    for e in refused:
        with pytest.raises(QueryFault) as error:
            n(e)
        assert error.value.code == "no_aggregate"


def test_series_and_totals(spark):
    hours = {"noon": NOON, "evening": NOON + dt.timedelta(hours=6)}
    rows = [("a", "app", 5.0, hours["noon"]), ("b", "app", 15.0, hours["evening"]), ("c", "pro", 25.0, hours["noon"]), ("d", "app", 25.0, hours["noon"])]
    declare = lambda s: s.field("product", "string", required=True).field("amount", "double", required=True).field("date", "timestamp").sum("amount", by="product", at="date").count(by="product", at="date")
    q = table(spark, declare, rows, "uuid string, product string, amount double, date timestamp")
    points = lambda df: [(r["grp"], (r["hour"] - NOON).seconds // 3600, r["value"]) for r in df.collect()]
    day = (NOON - dt.timedelta(hours=10), NOON + dt.timedelta(hours=14))
    assert points(q.series(*day, "amount", "sum", "product")) == [("app", 0, 30), ("pro", 0, 25), ("app", 6, 15)]
    assert points(q.series(*day, "amount", "average", "product")) == [("app", 0, 15), ("pro", 0, 25), ("app", 6, 15)]
    assert points(q.series(hours["evening"], day[1], group="product")) == [("app", 6, 1)]
    # a first hour that is only partly in the range is out
    assert points(q.series(NOON + dt.timedelta(minutes=1), day[1], group="product")) == [("app", 6, 1)]
    assert points(q.filter(attr("product") == "pro").series(*day, group="product")) == [("pro", 0, 1)]
    two = q.filter((attr("product") == "pro") & (attr("product") == "app"))
    assert points(two.series(*day, group="product")) == []
    assert [(r["grp"], r["value"]) for r in q.totals("amount", "sum", "product").collect()] == [("app", 45), ("pro", 25)]
    for wrong, code in ((q.filter((attr("product") == "a") | (attr("amount") == 1)), "disjunction_unsupported"), (q.filter(attr("product") != "a"), "equality_only"), (q.filter((attr("product") == "a") | (attr("product") == "b")), "equality_only")):
        with pytest.raises(QueryFault) as error:
            wrong.totals(group="product")
        assert error.value.code == code
    with pytest.raises(QueryFault):
        q.totals("amount", "max", "product")


def test_missing_group_is_the_empty_one(spark):
    q = table(spark, lambda s: s.field("g", "string"), [("a", ""), ("b", None), ("c", "x")], "uuid string, g string")
    assert [(r["grp"], r["value"]) for r in q.totals(group="g").collect()] == [("", 2), ("x", 1)]


def test_percentiles(spark):
    declare = lambda s: s.field("latency", "double").histogram("latency", [10, 20, 30, 40])
    q = table(spark, declare, [(str(i), v) for i, v in enumerate([5.0, 15.0, 15.0, 25.0, 35.0, None])], "uuid string, latency double")
    assert q.percentile(0.5, "latency") == 17.5 and q.percentile(0.9, "latency") == 35
    low = table(spark, declare, [(str(i), float(i)) for i in (1, 2, 3)], "uuid string, latency double")
    high = table(spark, declare, [(str(i), 100.0 * i) for i in (1, 2, 3)], "uuid string, latency double")
    assert low.percentile(0.5, "latency") == 10 and high.percentile(1.0, "latency") == 40
    empty = table(spark, declare, [], "uuid string, latency double")
    assert empty.percentile(0.5, "latency") is None
    for call, code in ((lambda: q.percentile(1.5, "latency"), "rank_out_of_range"), (lambda: q.filter(attr("latency") > 1).percentile(0.5, "latency"), "filtered_histogram")):
        with pytest.raises(QueryFault) as error:
            call()
        assert error.value.code == code


def test_refusals(spark, purchases):
    codes = []
    optional = table(spark, lambda s: s.field("n", "int").field("b", "bytes").field("p", "int", payload=True).sum("n"), [], "uuid string, n long, b binary, p long")
    for call in (
        lambda: purchases.page(2), lambda: purchases.sum("product"), lambda: optional.average("n"), lambda: optional.sort("b").frame(), lambda: optional.sort("p").page(2),
        lambda: purchases.percentile(0.5, "amount"), lambda: purchases.filter(attr("nope") == 1),
    ):
        with pytest.raises(SchemaError) as error:
            call()
        codes.append(error.value.code)
    assert codes == ["single_sort_required", "non_numeric_field", "average_of_optional", "unsortable_field", "unpageable_field", "no_histogram", "unknown_field"]
    assert optional.sort("p").frame().collect() == []


def test_hours_and_buckets(spark):
    pairs = {36000: 82, 1785937500: 61, 1785715200: 0, 1786319999: 167, -68400: 53}
    df = spark.createDataFrame([(k,) for k in pairs], "s long").select("s", hour_of_week(F.timestamp_seconds("s")).alias("h"))
    assert {r["s"]: r["h"] for r in df.collect()} == pairs
    values = {5.0: 0, 10.0: 1, 39.9: 3, 40.0: 4, 4000.0: 4}
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", bucket(F.col("v"), [10, 20, 30, 40]).alias("b"))
    assert {r["v"]: r["b"] for r in df.collect()} == values


def test_canonical_keys(spark):
    row = spark.range(1).select(
        canonical(F.lit("a"), FieldType.STRING), canonical(F.lit(5), FieldType.INT), canonical(F.lit(5.0), FieldType.DOUBLE), canonical(F.lit(b"ab"), FieldType.BYTES),
        canonical(F.timestamp_millis(F.lit(1500)), FieldType.TIMESTAMP), canonical(F.lit("u"), FieldType.REFERENCE), canonical(F.array(F.lit("a"), F.lit("b")), FieldType.STRING_LIST),
        canonical(F.array(F.lit(1), F.lit(2)), FieldType.INT_LIST), canonical(F.lit(None).cast("long"), FieldType.INT),
    ).first()
    assert tuple(row) == ("a", "i5", "d5.0", "bYWI=", "t1500", "ru", "a,b", "i[1,2]", None)


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("cast(id as string) uuid", "id n", "id m").write.parquet(path)
    r = Registry()
    r.schema("t").field("n", "int").field("m", "int").create()
    q = over(r.definition("t"), spark.read.parquet(path)).filter((attr("n") > 5) & attr("m").isin([7, 8]))
    plan = q.frame().select("uuid")._jdf.queryExecution().toString()
    assert "GreaterThan(n,5)" in plan and "In(m, [7,8])" in plan


def test_values_survive_json(spark):
    when = dt.datetime(2024, 1, 2, 3, 4, 5, 678000)
    values = {
        FieldType.STRING: "a", FieldType.INT: 5, FieldType.DOUBLE: 2.5, FieldType.TIMESTAMP: when, FieldType.BYTES: bytearray(b"ab"), FieldType.REFERENCE: "u", FieldType.STRING_LIST: ["a", "b"],
        FieldType.INT_LIST: [1], FieldType.DOUBLE_LIST: [], FieldType.TIMESTAMP_LIST: [when], FieldType.REFERENCE_LIST: ["r"], FieldType.BYTES_LIST: [bytearray(b"x")],
    }
    frame = spark.range(1)
    for kind, v in values.items():
        df = spark.createDataFrame([(v,), (None,)], f"v {kind.spark.simpleString()}")
        rows = df.select("v", value_json(F.col("v"), kind).alias("j")).withColumn("back", from_value_json(F.col("j"), kind)).collect()
        assert [r["back"] for r in rows] == [v, None] and rows[1]["j"] is None, kind
    assert frame.select(from_value_json(F.lit('{"int":5}'), FieldType.STRING)).first()[0] is None
    assert frame.select(value_json(F.lit(5), FieldType.INT)).first()[0] == '{"int":5}'


def test_digest_escapes(spark):
    import hashlib

    got = spark.range(1).select(digest(F.lit("a|b"), F.lit("c\\"))).first()[0]
    assert got == hashlib.sha256(b"a\\|b|c\\\\").hexdigest()

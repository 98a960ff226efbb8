"""The registered queries over the entity store's operators, each with its SQL, over the whole of its table."""

from __future__ import annotations

import datetime as dt
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import canonical, digest, from_value_json, hour_of_week, search_tokens, value_json, week_of
from tarn.operators import rollups, writes
from tarn.operators.filters import attr
from tarn.plans.query import Cursor, Query, over
from tarn.registry import Registry
from tarn.schema import Aggregate, Entity
from tarn.sources import read_table, scratch_dir
from tarn.sources.store import Store
from tarn.types import FieldType

BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0]
START, END = dt.datetime(2024, 1, 8, 0, 30), dt.datetime(2024, 1, 15)


@cache
def registry() -> Registry:
    r = Registry()
    order = r.schema("order").field("custkey", "int", ungrouped=True).field("status", "string", required=True).field("total", "double", required=True, ungrouped=True)
    order.field("date", "timestamp").field("priority", "string", required=True)
    order.sum("total").min("total").max("total").count().sum("total", by="status").sum("total", by="priority").min("total", by="priority").max("total", by="priority")
    order.create()
    part = r.schema("part").field("name", "string", ungrouped=True).field("brand", "string").field("size", "int", required=True, min=1, max=50).field("price", "double", ungrouped=True)
    part.field("words", "stringList").sum("price", by="size").create()
    r.schema("customer").field("name", "string", ungrouped=True).field("balance", "double", ungrouped=True).field("segment", "string").create()
    event = r.schema("event").field("date", "timestamp").field("user", "int", ungrouped=True).field("type", "string", ungrouped=True).field("value", "double", required=True, ungrouped=True)
    event.sum("value", by="type", at="date").count(by="type", at="date").min("value", by="type", at="date").max("value", by="type", at="date")
    event.histogram("value", BOUNDS).count(at="date").create()
    r.schema("document").field("text", "text").field("lang", "string").field("source", "string").create()
    return r


def entity(name: str) -> Entity:
    return registry().definition(name)


def orders(s: SparkSession, d: str) -> DataFrame:
    o = read_table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("uuid"), F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").cast("timestamp").alias("date"), F.col("o_orderpriority").alias("priority"))


def parts(s: SparkSession, d: str) -> DataFrame:
    p = read_table(s, d, "part")
    return p.select(F.col("p_partkey").alias("uuid"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("price"), F.split("p_name", " ").alias("words"))


def customers(s: SparkSession, d: str) -> DataFrame:
    c = read_table(s, d, "customer")
    return c.select(F.col("c_custkey").alias("uuid"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))


def events(s: SparkSession, d: str, missing: str | None = None) -> DataFrame:
    e = read_table(s, d, "events")
    kind = F.col("event_type") if missing is None else F.nullif(F.col("event_type"), F.lit(missing))
    return e.select(F.col("event_id").alias("uuid"), F.col("ts").cast("timestamp").alias("date"), F.col("user_id").alias("user"), kind.alias("type"), "value")


def order(s: SparkSession, d: str) -> Query:
    return over(entity("order"), orders(s, d))


def part(s: SparkSession, d: str) -> Query:
    return over(entity("part"), parts(s, d))


def customer(s: SparkSession, d: str) -> Query:
    return over(entity("customer"), customers(s, d))


def event(s: SparkSession, d: str, missing: str | None = None) -> Query:
    return over(entity("event"), events(s, d, missing))


def document(s: SparkSession, d: str) -> Query:
    t = read_table(s, d, "documents")
    return over(entity("document"), t.select(F.col("doc_id").alias("uuid"), "text", "lang", "source"))


# what each query returns

_ORDER = "o_orderkey AS uuid, o_orderstatus AS status, o_totalprice AS total, o_orderpriority AS priority"
_PART = "p_partkey AS uuid, p_name AS name, CAST(p_size AS BIGINT) AS size"
_CUSTOMER = "c_custkey AS uuid, c_acctbal AS balance, c_mktsegment AS segment"


def _o(q: Query | DataFrame) -> DataFrame:
    return (q.frame() if isinstance(q, Query) else q).select("uuid", "status", "total", "priority")


def _p(q: Query | DataFrame) -> DataFrame:
    return (q.frame() if isinstance(q, Query) else q).select("uuid", "name", "size")


def _c(q: Query | DataFrame) -> DataFrame:
    return (q.frame() if isinstance(q, Query) else q).select("uuid", "balance", "segment")


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Sums of doubles depend on their order in the last places."""
    return df.withColumn("value", F.round("value", places))


_ENTRIES: dict[str, tuple] = {}


def _register(name: str, query, sql: str) -> None:
    _ENTRIES[name] = (query, sql)


def _filters() -> None:
    o = lambda e: lambda s, d: _o(order(s, d).filter(e))
    p = lambda e: lambda s, d: _p(part(s, d).filter(e))
    c = lambda e: lambda s, d: _c(customer(s, d).filter(e))
    so, sp, sc = (lambda w: f"SELECT {_ORDER} FROM orders WHERE {w}"), (lambda w: f"SELECT {_PART} FROM part WHERE {w}"), (lambda w: f"SELECT {_CUSTOMER} FROM customer WHERE {w}")
    status, total, priority, size, name, segment = (attr(x) for x in ("status", "total", "priority", "size", "name", "segment"))
    _register("filter_equals", o(status == "F"), so("o_orderstatus = 'F'"))
    _register("filter_not_equals", o(status != "F"), so("o_orderstatus <> 'F'"))
    _register("filter_gt", o(total > 200000), so("o_totalprice > 200000"))
    _register("filter_gte", p(size >= 40), sp("p_size >= 40"))
    _register("filter_lt", o(total < 50000.5), so("o_totalprice < 50000.5"))
    _register("filter_lte", p(size <= 10), sp("p_size <= 10"))
    _register("filter_in", c(segment.isin(["BUILDING", "MACHINERY"])), sc("c_mktsegment IN ('BUILDING', 'MACHINERY')"))
    _register("filter_not_in", c(segment.notin(["BUILDING", "MACHINERY"])), sc("c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"))
    _register("filter_in_empty", c(segment.isin([])), sc("false"))
    _register(
        "filter_not_in_missing", lambda s, d: event(s, d, "view").filter(attr("type").notin(["click"])).frame().select("uuid", "type"),
        "SELECT event_id AS uuid, nullif(event_type, 'view') AS type FROM events WHERE nullif(event_type, 'view') NOT IN ('click')",
    )
    _register(
        "filter_not_equals_missing", lambda s, d: event(s, d, "view").filter(attr("type") != "click").frame().select("uuid", "type"),
        "SELECT event_id AS uuid, nullif(event_type, 'view') AS type FROM events WHERE nullif(event_type, 'view') <> 'click'",
    )
    _register("filter_begins_with", p(name.begins_with("a")), sp("starts_with(p_name, 'a')"))
    _register("filter_contains", p(name.contains("in")), sp("contains(p_name, 'in')"))
    _register("filter_list_contains", p(attr("words").contains("blue")), sp("list_contains(string_split(p_name, ' '), 'blue')"))
    _register(
        "filter_search", lambda s, d: document(s, d).filter(attr("text").search("The OF")).frame().select("uuid", "lang"),
        "SELECT doc_id AS uuid, lang FROM documents WHERE list_has_all(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> ''), ['the', 'of'])",
    )
    date = attr("date")
    _register("filter_date_range", o((date >= dt.datetime(1995, 1, 1)) & (date < dt.datetime(1996, 1, 1))), so("o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'"))
    _register("filter_and_or_dnf", o(((status == "F") & (total > 300000)) | (total > 350000)), so("(o_orderstatus = 'F' AND o_totalprice > 300000) OR o_totalprice > 350000"))
    _register("filter_or_folds_in", o((priority == "1-URGENT") | (priority == "2-HIGH") | (priority == "5-LOW")), so("o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')"))
    _register("filter_contradiction", o((status == "F") & (status == "O")), so("o_orderstatus = 'F' AND o_orderstatus = 'O'"))


def _records() -> None:
    _register(
        "sort_multi_take", lambda s, d: _o(order(s, d).filter(attr("status") == "F").sort("priority").sort("total", reverse=True).frame(20)),
        f"SELECT {_ORDER} FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 20",
    )
    missing = "SELECT event_id AS uuid, nullif(event_type, 'view') AS type FROM events ORDER BY "
    _register("sort_missing_first", lambda s, d: event(s, d, "view").sort("type").frame(3000).select("uuid", "type"), missing + "type ASC NULLS FIRST, uuid LIMIT 3000")
    _register("sort_missing_last", lambda s, d: event(s, d, "view").sort("type", reverse=True).frame(3000).select("uuid", "type"), missing + "type DESC NULLS LAST, uuid LIMIT 3000")
    _register("limit_smallest", lambda s, d: _p(part(s, d).sort("size").limit(50).limit(30).frame(40)), f"SELECT {_PART} FROM part ORDER BY p_size, p_partkey LIMIT 30")
    _register("first_record", lambda s, d: _o(order(s, d).sort("total").limit(0).first_frame()), f"SELECT {_ORDER} FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
    page = lambda where, way: f"SELECT {_PART} FROM part WHERE {where} ORDER BY p_size {way}, p_partkey LIMIT 50"
    _register("page_first", lambda s, d: _p(part(s, d).sort("size").page_frame(50)), page("true", "ASC"))
    _register("page_after_asc", lambda s, d: _p(part(s, d).sort("size").page_frame(50, Cursor(10, 100))), page("p_size > 10 OR (p_size = 10 AND p_partkey > 100)", "ASC"))
    _register("page_after_desc", lambda s, d: _p(part(s, d).sort("size", reverse=True).page_frame(50, Cursor(10, 100))), page("p_size < 10 OR (p_size = 10 AND p_partkey > 100)", "DESC"))
    _register("page_ties", lambda s, d: _p(part(s, d).filter(attr("size") == 7).sort("size").page_frame(50, Cursor(7, 500))), page("p_size = 7 AND p_partkey > 500", "ASC"))
    _register("fetch_uuids", lambda s, d: _o(orders(s, d).where(F.col("uuid").isin(1, 7, 39, 100, 2500, -1)).orderBy("uuid")), f"SELECT {_ORDER} FROM orders WHERE o_orderkey IN (1, 7, 39, 100, 2500, -1)")
    _register(
        "union_distinct", lambda s, d: _c(customer(s, d).filter((attr("balance") < 0) | (attr("segment") == "BUILDING"))),
        f"SELECT {_CUSTOMER} FROM customer WHERE c_acctbal < 0 UNION SELECT {_CUSTOMER} FROM customer WHERE c_mktsegment = 'BUILDING'",
    )


def _folds() -> None:
    one = lambda e, w="true": f"SELECT {e} AS value FROM orders WHERE {w}"
    status = attr("status")
    count = "CAST(count(*) AS BIGINT)"
    _register("count_all", lambda s, d: order(s, d).count_frame(), one(count))
    _register("count_group", lambda s, d: order(s, d).filter(status == "F").count_frame(), one(count, "o_orderstatus = 'F'"))
    _register("count_in", lambda s, d: order(s, d).filter((status == "F") | (status == "P")).count_frame(), one(count, "o_orderstatus IN ('F', 'P')"))
    _register("count_limit", lambda s, d: order(s, d).limit(10).count_frame(), one("least(CAST(count(*) AS BIGINT), 10)"))
    _register("count_threshold", lambda s, d: part(s, d).filter(attr("size") > 15).count_frame(), "SELECT CAST(count(*) AS BIGINT) AS value FROM part WHERE p_size > 15")
    _register("sum_threshold", lambda s, d: rounded(part(s, d).filter((attr("size") >= 5) & (attr("size") <= 12)).sum_frame("price"), 2), "SELECT round(sum(p_retailprice), 2) AS value FROM part WHERE p_size BETWEEN 5 AND 12")
    _register("sum_all", lambda s, d: rounded(order(s, d).sum_frame("total"), 2), one("round(sum(o_totalprice), 2)"))
    _register("sum_none", lambda s, d: order(s, d).filter(status == "X").sum_frame("total"), one("coalesce(sum(o_totalprice), 0.0)", "o_orderstatus = 'X'"))
    _register("min_all", lambda s, d: order(s, d).min_frame("total"), one("min(o_totalprice)"))
    _register("max_all", lambda s, d: order(s, d).max_frame("total"), one("max(o_totalprice)"))
    _register("average_all", lambda s, d: rounded(order(s, d).average_frame("total")), one("round(sum(o_totalprice) / count(*), 4)"))
    _register("sum_group", lambda s, d: rounded(order(s, d).filter(status == "O").sum_frame("total"), 2), one("round(sum(o_totalprice), 2)", "o_orderstatus = 'O'"))
    _register("average_group", lambda s, d: rounded(order(s, d).filter(status == "O").average_frame("total")), one("round(sum(o_totalprice) / count(*), 4)", "o_orderstatus = 'O'"))
    by = lambda e, w="true": f"SELECT o_orderpriority AS grp, {e} AS value FROM orders WHERE {w} GROUP BY 1"
    _register("totals_count", lambda s, d: order(s, d).totals(group="priority"), by("CAST(count(*) AS DOUBLE)"))
    _register("totals_sum", lambda s, d: rounded(order(s, d).totals("total", "sum", "priority"), 2), by("round(sum(o_totalprice), 2)"))
    _register("totals_min", lambda s, d: order(s, d).totals("total", "min", "priority"), by("min(o_totalprice)"))
    _register("totals_max", lambda s, d: order(s, d).totals("total", "max", "priority"), by("max(o_totalprice)"))
    _register("totals_average", lambda s, d: rounded(order(s, d).totals("total", "average", "priority")), by("round(sum(o_totalprice) / count(*), 4)"))
    _register("totals_one_group", lambda s, d: rounded(order(s, d).filter(attr("priority") == "2-HIGH").totals("total", "sum", "priority"), 2), by("round(sum(o_totalprice), 2)", "o_orderpriority = '2-HIGH'"))
    _register("totals_ungrouped", lambda s, d: rounded(order(s, d).totals("total", "sum"), 2), "SELECT '' AS grp, round(sum(o_totalprice), 2) AS value FROM orders")
    _register("totals_int_keys", lambda s, d: part(s, d).totals(group="size"), "SELECT 'i' || p_size AS grp, CAST(count(*) AS DOUBLE) AS value FROM part GROUP BY 1")


def _series() -> None:
    within = f"date_trunc('hour', ts) >= TIMESTAMP '{START}' AND date_trunc('hour', ts) < TIMESTAMP '{END}'"
    hours = lambda e, w="true", g="event_type": f"SELECT {g} AS grp, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, {e} AS value FROM events WHERE {within} AND {w} GROUP BY 1, 2"
    plain = lambda df: df.withColumn("hour", F.col("hour").cast("timestamp_ntz"))
    ask = lambda s, d, name, metric, missing=None: plain(event(s, d, missing).series(START, END, name, metric, "type"))
    _register("series_sum", lambda s, d: rounded(ask(s, d, "value", "sum")), hours("round(sum(value), 4)"))
    _register("series_count", lambda s, d: ask(s, d, None, "count"), hours("CAST(count(*) AS DOUBLE)"))
    _register("series_average", lambda s, d: rounded(ask(s, d, "value", "average")), hours("round(sum(value) / count(*), 4)"))
    _register("series_min", lambda s, d: ask(s, d, "value", "min"), hours("min(value)"))
    _register("series_max", lambda s, d: ask(s, d, "value", "max"), hours("max(value)"))
    _register("series_one_group", lambda s, d: rounded(plain(event(s, d).filter(attr("type") == "click").series(START, END, "value", "sum", "type"))), hours("round(sum(value), 4)", "event_type = 'click'"))
    _register("series_ungrouped", lambda s, d: plain(event(s, d).series(START, END)), hours("CAST(count(*) AS DOUBLE)", g="''"))
    _register("series_undated_missing", lambda s, d: ask(s, d, None, "count", "view"), hours("CAST(count(*) AS DOUBLE)", g="coalesce(nullif(event_type, 'view'), '')"))

    def week_hours(s: SparkSession, d: str) -> DataFrame:
        cells = rollups.build(events(s, d), Aggregate(date="date"), entity("event"), F.lit(None).cast("timestamp"))
        return cells.select(week_of(F.col("hour")).cast("date").cast("string").alias("week"), hour_of_week(F.col("hour")).alias("hour_of_week"), "value")

    _register(
        "week_hour_cells", week_hours,
        "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, CAST(date_diff('hour', CAST(date_trunc('week', ts) AS TIMESTAMP), CAST(date_trunc('hour', ts) AS TIMESTAMP)) AS INTEGER) AS hour_of_week, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2",
    )
    bucket = "CASE " + " ".join(f"WHEN value < {b} THEN 'i{i}'" for i, b in enumerate(BOUNDS)) + f" ELSE 'i{len(BOUNDS)}' END"
    histogram = next(a for a in entity("event").aggregates if a.metric == "histogram")
    _register("histogram", lambda s, d: rollups.totals(event(s, d).cells(histogram), histogram), f"SELECT {bucket} AS grp, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1")

    def percentile(rank: float) -> str:
        edges = ", ".join(map(str, BOUNDS))
        return f"""WITH b AS (SELECT {bucket.replace("'i", "").replace("'", "")} AS bucket, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1),
            c AS (SELECT bucket, n, sum(n) OVER (ORDER BY bucket) AS cum, sum(n) OVER () * {rank} AS target FROM b),
            h AS (SELECT * FROM c WHERE cum >= target ORDER BY bucket LIMIT 1)
            SELECT round(CASE WHEN bucket = 0 THEN {BOUNDS[0]} WHEN bucket = {len(BOUNDS)} THEN {BOUNDS[-1]}
            ELSE [{edges}][bucket] + (target - (cum - n)) / n * ([{edges}][bucket + 1] - [{edges}][bucket]) END, 6) AS value FROM h"""

    for name, rank in (("percentile_50", 0.5), ("percentile_95", 0.95), ("percentile_25", 0.25), ("percentile_edge_low", 0.0), ("percentile_edge_high", 1.0)):
        _register(name, lambda s, d, rank=rank: rounded(event(s, d).percentile_frame(rank, "value"), 6), percentile(rank))


def _rewrites(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and a later batch that rewrites those of even key: half the total, another status."""
    first = orders(s, d).withColumn("_version", F.lit(1)).withColumn("_written", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    second = first.where("uuid % 2 = 0").withColumn("total", F.col("total") / 2).withColumn("status", F.lit("R")).withColumn("_written", F.lit("2024-01-02 05:00:00").cast("timestamp"))
    return first, second


def _log(s: SparkSession, d: str) -> DataFrame:
    first, second = _rewrites(s, d)
    return first.withColumn("_batch", F.lit(1)).unionByName(second.withColumn("_batch", F.lit(2)))


_NEW = "WITH log AS (SELECT o_orderkey AS uuid, o_orderstatus AS status, o_totalprice AS total, o_orderpriority AS priority FROM orders), new AS (SELECT uuid, CASE WHEN uuid % 2 = 0 THEN 'R' ELSE status END AS status, CASE WHEN uuid % 2 = 0 THEN total / 2 ELSE total END AS total, priority FROM log) "


def _writes() -> None:
    rollup = lambda name: next(a for a in entity("order").aggregates if a.name == name)
    _register("upsert_last_wins", lambda s, d: writes.replaced(*_rewrites(s, d)).select("uuid", "status", "total", "priority"), _NEW + "SELECT * FROM new")

    def deduped(s: SparkSession, d: str) -> DataFrame:
        first, second = _rewrites(s, d)
        batch = first.withColumn("_position", F.col("uuid")).unionByName(second.withColumn("_position", F.col("uuid") + 1_000_000_000))
        return writes.one_per_key(batch).select("uuid", "status", "total", "_position")

    _register("upsert_batch_dedupe", deduped, _NEW + "SELECT uuid, status, total, uuid AS _position FROM new")
    folded = lambda name: lambda s, d: rollups.totals(writes.from_log(_log(s, d), rollup(name), entity("order")), rollup(name))
    _register("running_min_after_rewrite", folded("min_total_by_priority"), _NEW + "SELECT priority AS grp, min(total) AS value FROM (SELECT * FROM log UNION ALL SELECT * FROM new) GROUP BY 1")
    _register("running_max_after_rewrite", folded("max_total_by_priority"), _NEW + "SELECT priority AS grp, max(total) AS value FROM (SELECT * FROM log UNION ALL SELECT * FROM new) GROUP BY 1")
    _register("sum_after_rewrite", lambda s, d: rounded(folded("sum_total_by_priority")(s, d), 3), _NEW + "SELECT priority AS grp, round(sum(total), 3) AS value FROM new GROUP BY 1")
    _register("count_after_move", folded("by_status"), _NEW + "SELECT status AS grp, CAST(count(*) AS DOUBLE) AS value FROM new GROUP BY 1")

    def cells(s: SparkSession, d: str) -> DataFrame:
        out = writes.from_log(_log(s, d), rollup("by_status"), entity("order"))
        return out.where("value <> 0").withColumn("hour", F.col("hour").cast("timestamp_ntz"))

    _register(
        "cells_after_move", cells,
        _NEW + """SELECT grp, hour, CAST(sum(v) AS DOUBLE) AS value FROM (
            SELECT status AS grp, TIMESTAMP '2024-01-01 00:00:00' AS hour, 1 AS v FROM log
            UNION ALL SELECT 'R', TIMESTAMP '2024-01-02 05:00:00', 1 FROM log WHERE uuid % 2 = 0
            UNION ALL SELECT status, TIMESTAMP '2024-01-02 05:00:00', -1 FROM log WHERE uuid % 2 = 0) GROUP BY 1, 2 HAVING sum(v) <> 0""",
    )

    strict = Registry()
    strict.schema("strict").field("segment", "string", default="none", allowed=["BUILDING", "MACHINERY", "none", "AUTOMOBILE"]).field("balance", "double", min=0, max=9000).field("name", "string", pattern=r"Customer#\d+").create()
    checked = strict.definition("strict")

    def given(s: SparkSession, d: str) -> DataFrame:
        rows = customers(s, d)
        return writes.with_defaults(rows.withColumn("segment", F.nullif(F.col("segment"), F.lit("FURNITURE"))).withColumn("name", F.when(F.col("uuid") % 10 == 0, F.concat("name", F.lit("\n"))).otherwise(F.col("name"))), checked)

    _register("defaults_applied", lambda s, d: given(s, d).select("uuid", "segment"), "SELECT c_custkey AS uuid, coalesce(nullif(c_mktsegment, 'FURNITURE'), 'none') AS segment FROM customer")
    _register(
        "violations", lambda s, d: writes.violations(given(s, d), checked).select("uuid", "fault"),
        """SELECT * FROM (SELECT c_custkey AS uuid, CASE WHEN coalesce(nullif(c_mktsegment, 'FURNITURE'), 'none') NOT IN ('BUILDING', 'MACHINERY', 'none', 'AUTOMOBILE') THEN 'outside_domain:segment'
            WHEN c_acctbal < 0 THEN 'below_minimum:balance' WHEN c_acctbal > 9000 THEN 'above_maximum:balance'
            WHEN NOT regexp_full_match(CASE WHEN c_custkey % 10 = 0 THEN c_name || chr(10) ELSE c_name END, 'Customer#\\d+') THEN 'pattern_mismatch:name' END AS fault FROM customer) WHERE fault IS NOT NULL""",
    )

    moved = Registry()
    moved.schema("moved").field("amount", "int").field("priority", "string").create()
    moved.schema("moved").field("total", "double").field("priority", "string").update()

    def versioned(s: SparkSession, d: str) -> DataFrame:
        rows = orders(s, d).select("uuid", (F.col("uuid") % 2 + 1).cast("int").alias("_version"), F.floor("total").cast("long").alias("amount"), F.col("total").alias("total__v2"), "priority")
        return writes.as_of_version(rows, moved.definition("moved")).select("uuid", F.col("amount").cast("double").alias("amount"), "total", "priority")

    _register(
        "versioned_read", versioned,
        "SELECT o_orderkey AS uuid, CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice) END AS amount, CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END AS total, o_orderpriority AS priority FROM orders",
    )

    def mistyped(s: SparkSession, d: str) -> DataFrame:
        rows = customers(s, d)
        other = value_json(F.col("balance").cast("string"), FieldType.STRING)
        balance = F.when(F.col("uuid") % 3 == 0, other).when(F.col("uuid") % 7 > 0, value_json(F.col("balance"), FieldType.DOUBLE))
        given = rows.select("uuid", balance.alias("balance"), value_json(F.col("name"), FieldType.STRING).alias("name"))
        return writes.violations(writes.from_values(given, checked), checked).select("uuid", "fault")

    _register(
        "violations_type_mismatch", mistyped,
        """SELECT * FROM (SELECT c_custkey AS uuid, CASE WHEN c_custkey % 3 = 0 THEN 'type_mismatch:balance' WHEN c_custkey % 7 = 0 THEN NULL
            WHEN c_acctbal < 0 THEN 'below_minimum:balance' WHEN c_acctbal > 9000 THEN 'above_maximum:balance'
            WHEN NOT regexp_full_match(c_name, 'Customer#\\d+') THEN 'pattern_mismatch:name' END AS fault FROM customer) WHERE fault IS NOT NULL""",
    )

    def keys(s: SparkSession, d: str) -> DataFrame:
        p = parts(s, d)
        return p.select("uuid", canonical(F.col("size"), FieldType.INT).alias("int_key"), canonical(F.col("brand"), FieldType.STRING).alias("string_key"), canonical(F.col("words"), FieldType.STRING_LIST).alias("list_key"), canonical(F.array("size", "uuid"), FieldType.INT_LIST).alias("ints_key"), canonical(F.col("name").cast("binary"), FieldType.BYTES).alias("bytes_key"))

    _register(
        "canonical_keys", keys,
        "SELECT p_partkey AS uuid, 'i' || p_size AS int_key, p_brand AS string_key, replace(p_name, ' ', ',') AS list_key, 'i[' || p_size || ',' || p_partkey || ']' AS ints_key, 'b' || base64(encode(p_name)) AS bytes_key FROM part",
    )
    _register(
        "canonical_dates", lambda s, d: events(s, d).select("uuid", canonical(F.col("date"), FieldType.TIMESTAMP).alias("date_key")),
        "SELECT event_id AS uuid, 't' || CAST(round(epoch_us(ts) / 1000.0) AS BIGINT) AS date_key FROM events",
    )


#: Doubles of every form, by an order's key: with many places, whole, tiny and huge, both signs.
_DOUBLE_SQL = "CASE o_orderkey % 6 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice * 1e-9 WHEN 2 THEN (o_orderkey % 5) * 1e16 WHEN 3 THEN -(o_orderkey % 4) * 1e-5 WHEN 4 THEN (o_orderkey % 3) + 12345678.9::DOUBLE ELSE (o_orderkey % 7) * 0.0001::DOUBLE END"


def _doubles() -> None:
    r = Registry()
    r.schema("reading").field("level", "double").create()
    reading = r.definition("reading")

    def readings(s: SparkSession, d: str) -> Query:
        k, total = F.col("uuid"), F.col("total")
        level = F.when(k % 6 == 0, total).when(k % 6 == 1, total * 1e-9).when(k % 6 == 2, (k % 5) * 1e16).when(k % 6 == 3, -(k % 4) * 1e-5).when(k % 6 == 4, (k % 3) + 12345678.9).otherwise((k % 7) * 0.0001)
        return over(reading, orders(s, d).select("uuid", (level + 0.0).alias("level")))

    among = [12345678.9, 0.0001, 1e16, -1e-5, 0.0, 2, 1e-300]
    _register(
        "count_double_group", lambda s, d: readings(s, d).filter(attr("level").isin(among)).count_frame(),
        f"SELECT CAST(count(*) AS BIGINT) AS value FROM (SELECT {_DOUBLE_SQL} + 0.0 AS level FROM orders) WHERE level IN ({', '.join(f'{float(v)!r}::DOUBLE' for v in among)})",
    )
    _register(
        "totals_double_keys", lambda s, d: readings(s, d).totals(group="level"),
        f"SELECT 'd' || CAST(level AS VARCHAR) AS grp, CAST(count(*) AS DOUBLE) AS value FROM (SELECT {_DOUBLE_SQL} + 0.0 AS level FROM orders) GROUP BY 1",
    )


def _order_store(s: SparkSession, d: str) -> Store:
    """A store of its own with all orders, then a batch that rewrites those of even key, each written by its columns."""
    store = Store(s, scratch_dir(s, "store"))
    store.registry.publish(entity("order"))
    for rows, hour in zip(_rewrites(s, d), (0, 5), strict=True):
        store.write("order", rows.drop("_version", "_written").withColumn("uuid", F.col("uuid").cast("string")), now=dt.datetime(2024, 1, 1 + hour // 5, hour, tzinfo=dt.timezone.utc), batch=hour, source="catalogue")
    return store


def _stored() -> None:
    """The same folds from records and rollups that a store has on disk."""
    plain = lambda df: df.withColumn("hour", F.col("hour").cast("timestamp_ntz"))

    def retried(s: SparkSession, d: str) -> DataFrame:
        store = Store(s, scratch_dir(s, "store"))
        store.registry.publish(entity("event"))
        rows = events(s, d).withColumn("uuid", F.col("uuid").cast("string"))
        for part, batch in ((0, 1), (1, 2), (0, 1), (1, 2), (0, 1)):
            store.write("event", rows.where(F.col("uuid").cast("long") % 2 == part), batch=batch, source="retry")
        store.write("event", rows.where(F.col("uuid").cast("long") % 5 == 0), batch=1, source="another")  # the same records again
        return rounded(plain(store.query("event").series(START, END, "value", "sum", "type")))

    def compacted(s: SparkSession, d: str) -> DataFrame:
        store = _order_store(s, d)
        store.compact("order")
        store.write("order", [], deleting=["1", "2", "3", "no such key"], now=dt.datetime(2024, 1, 3, tzinfo=dt.timezone.utc))
        store.compact("order")
        return store.query("order").totals(group="status")

    def fetched(s: SparkSession, d: str) -> DataFrame:
        store = _order_store(s, d)
        store.compact("order")
        store.write("order", [{"uuid": "39", "status": "Z", "total": 1, "priority": "none"}], deleting=["7"])
        rows = store.fetch_in_order("order", ["2500", "39", "1", "7", "-1", "100", "2", "39"])
        return rows.select(F.col("uuid").cast("long").alias("uuid"), "status", "total", "priority")

    _register("store_records", lambda s, d: _order_store(s, d).query("order").frame().select(F.col("uuid").cast("long").alias("uuid"), "status", "total", "priority"), _NEW + "SELECT * FROM new")
    _register("store_totals_after_rewrite", lambda s, d: rounded(_order_store(s, d).query("order").totals("total", "sum", "priority"), 3), _NEW + "SELECT priority AS grp, round(sum(total), 3) AS value FROM new GROUP BY 1")
    within = f"date_trunc('hour', ts) >= TIMESTAMP '{START}' AND date_trunc('hour', ts) < TIMESTAMP '{END}'"
    _register("store_series_after_retry", retried, f"SELECT event_type AS grp, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, round(sum(value), 4) AS value FROM events WHERE {within} GROUP BY 1, 2")
    _register("store_count_after_compact", compacted, _NEW + "SELECT status AS grp, CAST(count(*) AS DOUBLE) AS value FROM new WHERE uuid NOT IN (1, 2, 3) GROUP BY 1")
    _register(
        "store_fetch", fetched,
        _NEW + """, now AS (SELECT uuid, status, total, priority FROM new WHERE uuid IN (2500, 1, 100, 2) UNION ALL SELECT 39, 'Z', 1.0, 'none' UNION ALL SELECT 39, 'Z', 1.0, 'none') SELECT * FROM now""",
    )


def _scalars() -> None:
    def json_values(s: SparkSession, d: str) -> DataFrame:
        p = parts(s, d)
        back = from_value_json(value_json(F.col("words"), FieldType.STRING_LIST), FieldType.STRING_LIST)
        return p.select("uuid", value_json(F.col("size"), FieldType.INT).alias("int_json"), value_json(F.col("words"), FieldType.STRING_LIST).alias("list_json"), F.array_join(back, " ").alias("back"))

    _register(
        "value_json", json_values,
        """SELECT p_partkey AS uuid, '{"int":' || p_size || '}' AS int_json, '{"strings":["' || replace(p_name, ' ', '","') || '"]}' AS list_json, p_name AS back FROM part""",
    )
    _register(
        "digest", lambda s, d: parts(s, d).select("uuid", digest(F.col("name"), F.concat(F.col("brand"), F.lit("|\\"))).alias("digest")),
        "SELECT p_partkey AS uuid, sha256(p_name || '|' || p_brand || '\\|\\\\') AS digest FROM part",
    )
    _register(
        "search_tokens", lambda s, d: document(s, d).filter(attr("lang") == "en").frame().select("uuid", F.size(search_tokens(F.col("text"))).alias("n")),
        "SELECT doc_id AS uuid, CAST(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS INTEGER) AS n FROM documents WHERE lang = 'en'",
    )
    _register(
        "search_tokens_all", lambda s, d: document(s, d).frame().select("uuid", F.size(search_tokens(F.col("text"))).alias("n")),
        "SELECT doc_id AS uuid, CAST(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS INTEGER) AS n FROM documents",
    )


@cache
def _all() -> dict[str, tuple]:
    for declare in (_filters, _records, _folds, _series, _writes, _doubles, _stored, _scalars):
        declare()
    return _ENTRIES


def queries() -> dict:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items()}

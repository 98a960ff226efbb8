import os
from urllib.parse import urlparse

from tarn.session import ARROW_BYTES, prepare, shared_dir
from tarn.sources import drop_scratch, read_table, scratch


def test_scratch_tables_cut_lineage_and_go(spark):
    drop_scratch(spark)
    df = scratch(spark.range(5).selectExpr("id", "id * 2 AS twice"), "numbers")
    assert df.columns == ["id", "twice"] and df.count() == 5
    path = urlparse(df.inputFiles()[0]).path
    assert path.startswith(urlparse(shared_dir(spark)).path)
    assert scratch(spark.range(0), "empty").count() == 0
    assert drop_scratch(spark) == 2 and not os.path.exists(os.path.dirname(path))


def test_tables_are_read_by_name(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/orders.parquet")
    assert read_table(spark, f"{tmp_path}/", "orders").count() == 3
    assert prepare(spark).conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get(ARROW_BYTES) == "4m"

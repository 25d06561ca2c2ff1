"""Sinks and sources keep values exact; guards fail loudly."""
import pytest
from pyspark.sql import functions as F

from basketry.session import shared_dir
from basketry.sinks import layers as LY
from basketry.sources.tables import path_exists, require_inputs


def test_csv_keeps_padding_and_empty_vs_null(spark):
    df = spark.createDataFrame([(1, " completed ", None, "a,b"), (2, "", "x", "")],
                               "order_id long, status string, order_date string, source_system string")
    path = shared_dir(spark, "csv")
    df.write.options(**LY._CSV).csv(path)
    back = {r.order_id: r for r in spark.read.schema("order_id long, status string, order_date string, source_system string")
            .options(**LY._CSV).csv(path).collect()}
    assert back[1].status == " completed " and back[1].order_date is None and back[1].source_system == "a,b"
    assert back[2].status == "" and back[2].source_system == ""


def test_dynamic_partition_overwrite(spark):
    path = shared_dir(spark, "silver")
    a = spark.createDataFrame([(1, 2024, 1), (2, 2024, 2)], "order_id long, order_year long, order_month long")
    LY.write_partitioned(a, path)
    LY.write_partitioned(spark.createDataFrame([(3, 2024, 2)], "order_id long, order_year long, order_month long"), path)
    ids = sorted(r.order_id for r in spark.read.parquet(path).collect())
    assert ids == [1, 3]       # January kept, February replaced


def test_path_guard(spark):
    assert path_exists(spark, "/root/testdata/sf0.001/orders.parquet")
    with pytest.raises(FileNotFoundError):
        require_inputs(spark, ["/root/testdata/sf0.001/orders.parquet", "/nonexistent/x.parquet"])


def test_silver_union_by_name(spark):
    root = shared_dir(spark, "u")
    LY.write_partitioned(spark.createDataFrame([(1, "a", 2024, 1)], "order_id long, s string, order_year long, order_month long"),
                         f"{root}/ok")
    spark.createDataFrame([(2, "b")], "order_id long, s string").write.parquet(f"{root}/bad")
    rows = {r.order_id: r for r in LY.silver_union(spark, f"{root}/ok", f"{root}/bad").collect()}
    assert rows[1].order_year == 2024 and rows[2].order_year is None and rows[2].s == "b"


def test_raw_files_roundtrip(spark):
    """B8 + A1-A4: raw feeds written as CSV / JSON / parquet read back unchanged."""
    from basketry.plans.context import RetailContext
    c = RetailContext(spark, "/root/testdata/sf0.001")
    paths = LY.write_raw_files(shared_dir(spark, "raw"), c.raw_orders, c.raw_customers, c.raw_items, c.raw_products)
    pairs = [(c.raw_orders, LY.read_orders_csv(spark, paths["orders"])),
             (c.raw_customers, LY.read_customers_json(spark, paths["customers"])),
             (c.raw_items, LY.read_items_csv(spark, paths["order_items"])),
             (c.raw_products, LY.read_products_parquet(spark, paths["products"]))]
    for src, back in pairs:
        assert src.exceptAll(back.select(*src.columns)).count() == 0
        assert back.count() == src.count()


def test_layers_are_written_compactly(spark):
    """Every layer writer uses Zstandard."""
    import glob

    import pyarrow.parquet as pq
    root = shared_dir(spark, "layers")
    df = spark.range(100).selectExpr("id", "cast(id % 2 as long) order_year", "cast(1 as long) order_month", "cast(id as string) day")
    LY.write_bronze(root, {"t": df})
    LY.write_parquet(df, f"{root}/gold")
    LY.write_partitioned(df, f"{root}/silver")
    seen = LY.write_measured(df, f"{root}/measured", {"first": F.min("id"), "last": F.max("id")})
    assert seen == {"first": 0, "last": 99}
    files = [f for d in ("bronze/t", "gold", "silver", "measured") for f in glob.glob(f"{root}/{d}/**/*.parquet", recursive=True)]
    codecs = {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files if pq.ParquetFile(f).metadata.num_rows}
    assert codecs == {"ZSTD"}
    assert spark.read.parquet(f"{root}/silver").count() == 100

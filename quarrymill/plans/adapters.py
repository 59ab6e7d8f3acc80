"""Views of the supplied tables in the shape the operators ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-11-04"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, four parts each, unless their files give as many: for work that costs far more than moving a row. A small file is one or a few tasks however many rows it holds."""
    parts = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts)


def cents(column: str):
    """Whole cents: sums of them don't depend on their order."""
    return F.floor(F.col(column) * 100 + 0.5).cast("long")


def sold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as sold records: a returned line keeps no units."""
    units = F.col("l_quantity").cast("long")
    age = F.datediff(F.lit(AS_OF).cast("date"), F.to_date("l_shipdate"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("item"),
        F.col("l_orderkey").alias("order_no"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_suppkey").alias("source"),
        units.alias("gross"),
        F.when(F.col("l_returnflag") == "R", F.lit(0).cast("long")).otherwise(units).alias("units"),
        cents("l_extendedprice").alias("cents"),
        F.floor(F.col("l_extendedprice") * F.col("l_discount") * 100 + 0.5).cast("long").alias("discount_cents"),
        F.when(F.col("l_linestatus") == "O", "new_sealed").when(F.col("l_returnflag") == "A", "used").otherwise("unknown").alias("condition"),
        F.when(age >= 0, age).alias("age"),
        F.col("l_shipdate").alias("sale_date"),
    )


SOLD_SQL = f"""sold AS (SELECT l_partkey AS item, l_orderkey AS order_no, l_linenumber AS line_no, l_suppkey AS source, l_quantity::BIGINT AS gross,
  CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity::BIGINT END AS units, floor(l_extendedprice * 100 + 0.5)::BIGINT AS cents,
  floor(l_extendedprice * l_discount * 100 + 0.5)::BIGINT AS discount_cents,
  CASE WHEN l_linestatus = 'O' THEN 'new_sealed' WHEN l_returnflag = 'A' THEN 'used' ELSE 'unknown' END AS condition,
  CASE WHEN date_diff('day', l_shipdate::DATE, DATE '{AS_OF}') >= 0 THEN date_diff('day', l_shipdate::DATE, DATE '{AS_OF}') END AS age, l_shipdate AS sale_date FROM lineitem)"""


def round_sql(x: str, places: int = 2) -> str:
    """round_half_up in SQL."""
    return f"(floor(({x} + 2.220446049250313e-16) * {10**places}.0::DOUBLE + 0.5) / {10**places}.0::DOUBLE)"


def plain_sql(x: str, places: int = 2) -> str:
    return f"(floor(({x}) * {10**places}.0::DOUBLE + 0.5) / {10**places}.0::DOUBLE)"

"""Files to typed rows, and rows to files."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.money import parse_price, round_half_up, short_month_date


def csv_with_found_header(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV files whose header is the first record that has all of `columns`; what stands before it is skipped.

    A quoted field may hold line breaks, so a file is one record of the scan (order exports are small files, and
    many of them); columns are found by name and returned as strings, blanks as null."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    fields = pa.schema([("path", pa.string()), ("row", pa.int64()), *((c, pa.string()) for c in columns)])

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at, held, n = None, [], 0
                for record in csv.reader(io.StringIO(content.decode("utf-8-sig", errors="replace"))):
                    if at is None:
                        found = [x.strip() for x in record]
                        at = [found.index(c) for c in columns] if set(columns) <= set(found) else None
                        continue
                    values = [record[i].strip() or None if i < len(record) else None for i in at]
                    if any(values):
                        held.append([name, n, *values])
                        n += 1
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), fields.types, strict=True)], schema=fields)

    return files.mapInArrow(run, "path string, row long, " + ", ".join(f"`{c}` string" for c in columns))


def order_lines(rows: DataFrame) -> DataFrame:
    """Sold lines of an order export: rows without a title or an amount go; shipping is the row's own, else its order header's, by unit."""
    amount = lambda c: parse_price(F.col(c))
    quantity = F.greatest(F.lit(1), F.floor(F.coalesce(amount("Quantity"), F.lit(1.0)))).cast("long")
    typed = rows.select(F.col("Order Number").alias("order_number"), F.col("Item Title").alias("title"), F.col("Custom Label").alias("label"), quantity.alias("quantity"), amount("Sold For").alias("sold_for"), amount("Shipping And Handling").alias("shipping"), short_month_date("Sale Date").alias("sale_date"))
    headers = typed.where(F.col("title").isNull() & (F.col("quantity") > 1)).groupBy("order_number").agg(F.max(F.col("shipping") / F.col("quantity")).alias("_header"))
    lines = typed.where(F.col("title").isNotNull() & F.col("sold_for").isNotNull()).join(headers, "order_number", "left")
    unit = round_half_up(F.coalesce(F.col("shipping") / F.col("quantity"), F.col("_header"), F.lit(0.0)))
    return lines.withColumn("shipping", unit).withColumn("total_paid", round_half_up(F.col("sold_for") + F.col("shipping"))).drop("_header")


def xml_items(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of XML files as rows of a given schema."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def versioned_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents of a known schema; no file, no rows."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def flattened_orders(orders: DataFrame) -> DataFrame:
    """order x line items: unit prices, refunds by unit; cancelled and failed orders go."""
    done = ~(F.coalesce(F.col("cancel_state"), F.lit("")).rlike("(?i)cancel") & ~F.coalesce(F.col("cancel_state"), F.lit("")).rlike("(?i)partial")) & ~F.coalesce(F.col("payment_status"), F.lit("")).rlike("(?i)failed|pending")
    each = orders.where(done).select("order_id", "creation_date", F.explode("line_items").alias("i"))
    refund = F.aggregate(F.coalesce("i.refunds", F.array()), F.lit(0.0), lambda a, r: a + r["amount"])
    q = F.greatest(F.lit(1), F.col("i.quantity"))
    return each.select(F.concat_ws(":", "order_id", "i.line_item_id").alias("record_key"), "order_id", F.to_date("creation_date").alias("sale_date"), F.col("i.title").alias("title"), q.alias("quantity"), round_half_up(F.col("i.line_item_cost") / q).alias("sold_for"), round_half_up(F.coalesce("i.shipping_cost", F.lit(0.0)) / q).alias("shipping"), round_half_up(refund / q).alias("refund"), F.col("i.currency").alias("currency"))


def date_slices(spark: SparkSession, first: str, last: str, days: int = 90) -> DataFrame:
    """Contiguous slices of at most `days` (1 to 90) days."""
    days = max(1, min(90, days))
    one = spark.range(1).select(F.explode(F.sequence(F.to_timestamp(F.lit(first)), F.to_timestamp(F.lit(last)), F.expr(f"interval {days} days"))).alias("from"))
    return one.select("from", F.least(F.col("from") + F.expr(f"interval {days} days") - F.expr("interval 1 millisecond"), F.to_timestamp(F.lit(last))).alias("to"))


class PagedSource(DataSource):
    """A paged API as a data source: one partition a slice, pages read one after another, so a host sees one request at a time.

    Options: slices (JSON list of [from, to]), page, and reader: "module:function" called with (from, to, offset, limit) that gives a list of JSON strings."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "slice int, offset long, body string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        import json

        return [InputPartition((i, *s)) for i, s in enumerate(json.loads(self.options["slices"]))]

    def read(self, partition):
        import importlib

        module, _, function = self.options["reader"].partition(":")
        fetch = getattr(importlib.import_module(module), function)
        page = int(self.options.get("page", 200))
        i, first, last = partition.value
        offset = 0
        while True:
            bodies = fetch(first, last, offset, page)
            yield from ((i, offset + k, b) for k, b in enumerate(bodies))
            if len(bodies) < page:
                return
            offset += page


DENIED = {"email", "phone", "buyername", "buyerusername", "address", "addressline1", "postalcode", "zipcode", "fullname", "firstname", "lastname", "taxid", "contactaddress", "shipto"}


def assert_no_private_columns(frame: DataFrame) -> None:
    """Raise where any field of the schema, at any depth, has a name of the deny list."""

    def walk(kind, path: str) -> None:
        for field in getattr(kind, "fields", ()):
            name = "".join(c for c in field.name.lower() if c.isalnum())
            if name in DENIED:
                raise ValueError(f"private field {path}{field.name}")
            walk(field.dataType, f"{path}{field.name}.")
        for inner in ("elementType", "valueType"):
            if hasattr(kind, inner):
                walk(getattr(kind, inner), path)

    walk(frame.schema, "")


def publish_run(frame: DataFrame, path: str, run_id: str, input_hash: str) -> bool:
    """Append a run once: True when written, False when the same run with the same input is there; another input under the same id raises."""
    spark = frame.sparkSession
    try:
        known = [r.input_hash for r in spark.read.parquet(path).where(F.col("run_id") == run_id).select("input_hash").distinct().collect()]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = []
    if known and known != [input_hash]:
        raise ValueError(f"run {run_id} is there with other content")
    if known:
        return False
    assert_no_private_columns(frame)
    frame.withColumns({"input_hash": F.lit(input_hash), "run_id": F.lit(run_id)}).write.mode("append").partitionBy("run_id").parquet(path)
    return True


def write_quoted_csv(frame: DataFrame, path: str, columns: list[str], order: list[Column]) -> None:
    frame.orderBy(*order).select(*columns).write.mode("overwrite").csv(path, header=True, quoteAll=True, emptyValue="")

"""Financial transactions dealt to the records that were sold: fees, credits, refunds, labels and charges, and what nothing sold explains.

transactions: txn_id, kind (SALE, REFUND, SHIPPING_LABEL, others are charges), order_id, item_id, currency, cents, total_fee_cents, fee_basis_cents, booking,
  category (of a charge: advertising, selling_fee or other), items array<struct<line_id, fees array<struct<cents, fee_type>>>>; cents are whole.
records: record_key (unique), order_id, line_id, item_id, currency, quantity, paid_cents (by unit).

A fee of a line goes to that line's record only. What a transaction has beyond them goes to its lines' records, else to all of its order's, else to
the only record of its item, dealt by what was paid. Sums are of whole cents and rounded once, so they don't depend on the order of transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decisions import chosen
from .ranking import allocate

FIELDS = ["sale_fees", "ad_fees", "fee_credits", "refunds", "label_debits", "label_credits", "other_charges"]
ADVERTISING = r"(?i)AD[_ ]FEE|PROMOTED|ADVERTIS"


def line_targets(lines: DataFrame, records: DataFrame) -> DataFrame:
    """lines (with order_id, line_id, currency) and `record_key`: the order's own line, else the only record with that line id; null for none."""
    own = records.select("order_id", "line_id", "currency", F.col("record_key").alias("_own"))
    only = records.groupBy("line_id", "currency").agg(F.count(F.lit(1)).alias("_n"), F.min("record_key").alias("_only")).where("_n = 1").drop("_n")
    return lines.join(own, ["order_id", "line_id", "currency"], "left").join(only, ["line_id", "currency"], "left").withColumn("record_key", F.coalesce("_own", "_only")).drop("_own", "_only")


def targets(transactions: DataFrame, records: DataFrame) -> DataFrame:
    """txn_id, record_key, method: the records that a transaction as a whole belongs to."""
    lines = transactions.select("txn_id", "order_id", "currency", F.explode("items.line_id").alias("line_id")).where("line_id IS NOT NULL")
    exact = line_targets(lines, records).where("record_key IS NOT NULL").select("txn_id", "record_key").distinct().withColumn("method", F.lit("exact_line_item"))
    left = transactions.select("txn_id", "order_id", "item_id", "currency").join(exact.select("txn_id"), "txn_id", "left_anti")
    order = left.join(records.select("order_id", "currency", "record_key"), ["order_id", "currency"]).select("txn_id", "record_key", F.lit("allocated_order").alias("method"))
    left = left.join(order.select("txn_id").distinct(), "txn_id", "left_anti")
    only = records.groupBy("item_id", "currency").agg(F.count(F.lit(1)).alias("_n"), F.min("record_key").alias("record_key")).where("_n = 1")
    item = left.join(only, ["item_id", "currency"]).select("txn_id", "record_key", F.lit("exact_item_reference").alias("method"))
    return exact.unionByName(order).unionByName(item)


def movements(transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fees of single lines, amounts of whole transactions): each with field, cents and the category it counts in where nothing explains it."""
    kind, absolute = F.col("kind"), lambda c: F.abs(F.coalesce(F.col(c), F.lit(0)))
    base = ["txn_id", "kind", "order_id", "item_id", "currency"]
    fees = transactions.where(kind.isin("SALE", "REFUND")).select(*base, F.explode("items").alias("i")).select(*base, F.col("i.line_id").alias("line_id"), F.explode("i.fees").alias("f"))
    ad, size = F.coalesce(F.col("f.fee_type").rlike(ADVERTISING), F.lit(False)), F.abs(F.col("f.cents"))
    credit = kind == "REFUND"
    single = fees.select(*base, "line_id", F.when(ad, "ad_fees").when(credit, "fee_credits").otherwise("sale_fees").alias("field"), F.when(ad & credit, -size).otherwise(size).alias("cents"), F.when(ad, "advertising").otherwise("selling_fees").alias("category"), F.when(credit, -size).otherwise(size).alias("loose"))
    given = F.aggregate(F.flatten(F.transform("items", lambda i: F.coalesce(i["fees"], F.array().cast("array<struct<cents: bigint, fee_type: string>>")))), F.lit(0).cast("long"), lambda a, f: a + F.abs(f["cents"]))
    rest = F.greatest(F.lit(0), absolute("total_fee_cents") - F.coalesce(given, F.lit(0)))
    signed = F.when(F.col("booking") == "CREDIT", -absolute("cents")).otherwise(absolute("cents"))
    label_credit = F.coalesce(F.col("booking") == "CREDIT", F.lit(False))
    refund = F.when(F.coalesce(F.col("fee_basis_cents"), F.lit(0)) != 0, absolute("fee_basis_cents")).otherwise(absolute("cents"))

    def amount(field, cents: Column, category, loose: Column) -> Column:
        value = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(value(field).alias("field"), cents.cast("long").alias("cents"), value(category).alias("category"), loose.cast("long").alias("loose"))

    charge = chosen([(F.col("category") == "advertising", "ad_fees"), (F.col("category") == "selling_fee", "sale_fees")], "other_charges")
    charged = chosen([(F.col("category") == "advertising", "advertising"), (F.col("category") == "selling_fee", "selling_fees")], "other_charges")
    parts = (
        F.when(kind == "SALE", F.array(amount("sale_fees", rest, "selling_fees", rest)))
        .when(kind == "REFUND", F.array(amount("refunds", refund, "refunds", refund), amount("fee_credits", rest, "selling_fees", -rest)))
        .when(kind == "SHIPPING_LABEL", F.array(amount(F.when(label_credit, "label_credits").otherwise("label_debits"), absolute("cents"), "shipping_labels", signed)))
        .otherwise(F.array(amount(charge, signed, charged, signed)))
    )
    whole = transactions.select(*base, F.explode(parts).alias("p")).select(*base, "p.*").where("cents <> 0")
    return single, whole


def attribute(transactions: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(record_key with the cents of every field, currency and category with the cents that nothing sold explains)."""
    single, whole = movements(transactions)
    single = line_targets(single, records)
    found = targets(transactions, records)
    weight = F.greatest(F.lit(1), F.coalesce(F.col("paid_cents"), F.lit(0)) * F.greatest(F.lit(1), F.floor(F.coalesce(F.col("quantity"), F.lit(1)))))
    shared = whole.join(found, "txn_id").join(records.select("record_key", weight.alias("weight")), "record_key")
    dealt = allocate(shared, ["txn_id", "field"], "weight", "cents", [F.col("record_key")], "dealt")
    parts = single.where("record_key IS NOT NULL").select("record_key", "field", "cents").unionByName(dealt.select("record_key", "field", F.col("dealt").alias("cents")))
    sums = parts.groupBy("record_key").agg(*[F.coalesce(F.sum(F.when(F.col("field") == f, F.col("cents"))), F.lit(0)).alias(f) for f in FIELDS])
    loose = single.where("record_key IS NULL").select("currency", "category", "loose").unionByName(whole.join(found.select("txn_id").distinct(), "txn_id", "left_anti").select("currency", "category", "loose"))
    return sums, loose.groupBy("currency", "category").agg(F.sum("loose").alias("cents"))


def net_economics(records: DataFrame, sums: DataFrame) -> DataFrame:
    """What is left of each record's payments, in cents: no field below zero, credits against their fees, the larger of both refunds."""
    total = F.col("paid_cents") * F.greatest(F.lit(1), F.floor("quantity"))
    f = records.join(sums, "record_key", "left")
    known = {c: F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0))) for c in FIELDS}
    fees, labels = F.greatest(F.lit(0), known["sale_fees"] - known["fee_credits"]), F.greatest(F.lit(0), known["label_debits"] - known["label_credits"])
    refund = F.greatest(known["refunds"], F.coalesce(F.col("fulfilment_refund_cents"), F.lit(0)) if "fulfilment_refund_cents" in records.columns else F.lit(0))
    return f.select("record_key", fees.alias("sale_fees"), known["ad_fees"].alias("ad_fees"), refund.alias("refund"), labels.alias("label_cost"), known["other_charges"].alias("other_charges"), (total - fees - known["ad_fees"] - refund - labels - known["other_charges"]).cast("long").alias("net_cents"))

"""Raw orders and financial transactions of a marketplace API, reduced to whitelisted fields: nothing about buyers gets further than here.

What isn't a sound identifier, date or amount is null; an order without id, date or sound line items gives no row, nor does a transaction without type,
date, id and amount. Amounts are whole cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decisions import charge_class
from ..functions.money import col

_MONEY = "struct<value: string, currency: string>"
ORDER = f"struct<orderId: string, creationDate: string, lastModifiedDate: string, orderFulfillmentStatus: string, orderPaymentStatus: string, cancelStatus: struct<cancelState: string>, lineItems: array<struct<lineItemId: string, legacyItemId: string, title: string, sku: string, quantity: int, lineItemCost: {_MONEY}, deliveryCost: struct<shippingCost: {_MONEY}>>>>"
_FEE = f"struct<amount: {_MONEY}, feeType: string>"
TRANSACTION = f"struct<transactionId: string, transactionType: string, transactionDate: string, transactionStatus: string, transactionMemo: string, bookingEntry: string, feeType: string, orderId: string, amount: {_MONEY}, totalFeeAmount: {_MONEY}, totalFeeBasisAmount: {_MONEY}, orderLineItems: array<struct<lineItemId: string, feeBasisAmount: {_MONEY}, marketplaceFees: array<{_FEE}>>>, references: array<struct<referenceId: string, referenceType: string>>>"


def identifier(c) -> Column:
    """A trimmed id of letters, digits and a few signs; anything else is null."""
    v = F.trim(col(c))
    return F.when(v.rlike(r"^[A-Za-z0-9!|:._-]{1,128}$"), v)


def constant(c) -> Column:
    """A name of an enumeration in upper case."""
    v = F.upper(F.trim(col(c)))
    return F.when(v.rlike("^[A-Z][A-Z0-9_]{0,63}$"), v)


def moment(c) -> Column:
    return F.try_to_timestamp(col(c))


def cents(amount: Column) -> Column:
    """Whole cents of a money struct."""
    return F.floor(amount["value"].try_cast("double") * 100 + 0.5).cast("long")


def currency(amount: Column) -> Column:
    v = F.upper(F.trim(amount["currency"]))
    return F.when(v.rlike("^[A-Z]{3}$"), v).otherwise("USD")


def sanitised_orders(raw: DataFrame, body: str) -> DataFrame:
    """order_id, created, modified, states and sound line items of every order that has an id, a date and any line item."""
    o = raw.select(F.from_json(F.col(body), ORDER).alias("o")).select("o.*")

    def line(i: Column) -> Column:
        return F.struct(
            identifier(i["lineItemId"]).alias("line_id"), identifier(i["legacyItemId"]).alias("item_id"), F.trim(i["title"]).alias("title"), identifier(i["sku"]).alias("sku"), F.greatest(F.lit(1), F.coalesce(i["quantity"], F.lit(1))).alias("quantity"),
            cents(i["lineItemCost"]).alias("cost_cents"), F.coalesce(cents(i["deliveryCost"]["shippingCost"]), F.lit(0).cast("long")).alias("shipping_cents"), currency(i["lineItemCost"]).alias("currency"),
        )

    items = F.filter(F.transform("lineItems", line), lambda i: i["line_id"].isNotNull() & i["cost_cents"].isNotNull() & (F.coalesce(i["title"], F.lit("")) != ""))
    out = o.select(identifier("orderId").alias("order_id"), moment("creationDate").alias("created"), moment("lastModifiedDate").alias("modified"), constant("orderFulfillmentStatus").alias("fulfilment"), constant("orderPaymentStatus").alias("payment"), constant("cancelStatus.cancelState").alias("cancel_state"), items.alias("items"))
    return out.where(F.col("order_id").isNotNull() & F.col("created").isNotNull() & (F.size("items") > 0))


def sanitised_transactions(raw: DataFrame, body: str) -> DataFrame:
    """Transactions in the shape that the attribution takes, with their references; the memo only tells the class of a charge."""
    t = raw.select(F.from_json(F.col(body), TRANSACTION).alias("t")).select("t.*")
    fee = lambda f: F.struct(cents(f["amount"]).alias("cents"), constant(f["feeType"]).alias("fee_type"))
    sound = lambda f: f["cents"].isNotNull() & f["fee_type"].isNotNull()
    item = lambda i: F.struct(identifier(i["lineItemId"]).alias("line_id"), F.filter(F.transform(F.coalesce(i["marketplaceFees"], F.array().cast(f"array<{_FEE}>")), fee), sound).alias("fees"))
    references = F.filter(F.transform("references", lambda r: F.struct(identifier(r["referenceId"]).alias("id"), constant(r["referenceType"]).alias("type"))), lambda r: r["id"].isNotNull() & r["type"].isNotNull())
    named = lambda pattern: F.get(F.filter(F.coalesce(references, F.array().cast("array<struct<id: string, type: string>>")), lambda r: r["type"].rlike(pattern)), F.lit(0))["id"]
    kind = constant("transactionType")
    out = t.select(
        identifier("transactionId").alias("txn_id"), kind.alias("kind"), moment("transactionDate").alias("date"), constant("transactionStatus").alias("status"), constant("bookingEntry").alias("booking"), F.coalesce(identifier("orderId"), named("ORDER")).alias("order_id"),
        named("^ITEM|^(?!.*LINE).*ITEM").alias("item_id"), currency(F.col("amount")).alias("currency"), cents(F.col("amount")).alias("cents"), F.coalesce(cents(F.col("totalFeeAmount")), F.lit(0).cast("long")).alias("total_fee_cents"),
        F.coalesce(cents(F.col("totalFeeBasisAmount")), F.lit(0).cast("long")).alias("fee_basis_cents"), charge_class(kind, constant("feeType"), F.coalesce("transactionMemo", F.lit(""))).alias("category"), F.transform("orderLineItems", item).alias("items"),
    )
    return out.where("txn_id IS NOT NULL AND kind IS NOT NULL AND date IS NOT NULL AND cents IS NOT NULL")

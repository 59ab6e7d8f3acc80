"""Financial attribution over the supplied tables: order lines as records, orders as transactions, with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import economics
from ..sources import orders
from .adapters import table
from .catalogue import query


def _records(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("item_id"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.sum(F.floor("l_extendedprice").cast("long")).alias("paid_cents"))
    return line.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("record_key"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line_id"), "item_id", F.lit("USD").alias("currency"), "quantity", "paid_cents")


def _transactions(spark, sf_dir):
    """Orders as transactions: every tenth without an order but with an item, every seventh in another currency."""
    k = F.col("o_orderkey")
    fee = F.floor(F.col("o_totalprice") / 100).cast("long")
    line = F.when(k % 3 != 0, F.lit(1).cast("long"))
    items = F.when(k % 4 < 2, F.array(F.struct(line.alias("line_id"), F.array(F.struct(fee.alias("cents"), F.when(k % 8 < 2, "AD_FEE").otherwise("FINAL_VALUE").alias("fee_type"))).alias("fees"))))
    return table(spark, sf_dir, "orders").select(
        k.alias("txn_id"), F.element_at(F.array(*[F.lit(x) for x in ("SALE", "REFUND", "SHIPPING_LABEL", "NON_SALE_CHARGE")]), (k % 4 + 1).cast("int")).alias("kind"), F.when(k % 10 != 9, k).alias("order_id"), F.when(k % 10 == 9, F.col("o_custkey")).alias("item_id"),
        F.when(k % 7 == 0, "EUR").otherwise("USD").alias("currency"), (fee * 3).alias("cents"), (fee + 50).alias("total_fee_cents"), F.when(k % 5 == 0, fee * 2).alias("fee_basis_cents"), F.when(k % 6 == 0, "CREDIT").otherwise("DEBIT").alias("booking"),
        F.when(k % 12 == 3, "advertising").when(k % 12 == 7, "selling_fee").otherwise("other").alias("category"), items.alias("items"),
    )


_DEALT_SQL = """rec AS (SELECT l_orderkey || ':' || l_linenumber AS record_key, l_orderkey AS order_id, l_linenumber AS line_id, min(l_partkey) AS item_id, sum(l_quantity::BIGINT)::BIGINT AS quantity, sum(floor(l_extendedprice))::BIGINT AS paid FROM lineitem GROUP BY l_orderkey, l_linenumber),
t AS (SELECT o_orderkey AS k, o_orderkey % 4 AS kind, floor(o_totalprice / 100)::BIGINT AS fee, CASE WHEN o_orderkey % 10 <> 9 THEN o_orderkey END AS order_id, CASE WHEN o_orderkey % 10 = 9 THEN o_custkey END AS item_id, CASE WHEN o_orderkey % 7 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
  CASE WHEN o_orderkey % 6 = 0 THEN -1 ELSE 1 END AS sign, CASE WHEN o_orderkey % 4 < 2 AND o_orderkey % 3 <> 0 THEN 1 END AS line FROM orders),
once AS (SELECT min(record_key) AS record_key, line_id FROM rec GROUP BY line_id HAVING count(*) = 1), oncei AS (SELECT min(record_key) AS record_key, item_id FROM rec GROUP BY item_id HAVING count(*) = 1),
lt AS (SELECT t.k, coalesce(r.record_key, o.record_key) AS record_key FROM t LEFT JOIN rec r ON r.order_id = t.order_id AND r.line_id = t.line LEFT JOIN once o ON o.line_id = t.line WHERE currency = 'USD' AND line IS NOT NULL),
x1 AS (SELECT k, record_key FROM lt WHERE record_key IS NOT NULL), x2 AS (SELECT t.k, r.record_key FROM t JOIN rec r USING (order_id) WHERE currency = 'USD' AND t.k NOT IN (SELECT k FROM x1)),
x3 AS (SELECT t.k, o.record_key FROM t JOIN oncei o USING (item_id) WHERE currency = 'USD' AND t.k NOT IN (SELECT k FROM x1) AND t.k NOT IN (SELECT k FROM x2)), tg AS (SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3),
m AS (SELECT k, currency, 'sale_fees' AS field, 50 AS cents, 'selling_fees' AS category, 50 AS loose FROM t WHERE kind = 0 UNION ALL SELECT k, currency, 'refunds', CASE WHEN k % 5 = 0 THEN fee * 2 ELSE fee * 3 END, 'refunds', CASE WHEN k % 5 = 0 THEN fee * 2 ELSE fee * 3 END FROM t WHERE kind = 1
  UNION ALL SELECT k, currency, 'fee_credits', 50, 'selling_fees', -50 FROM t WHERE kind = 1 UNION ALL SELECT k, currency, CASE WHEN sign < 0 THEN 'label_credits' ELSE 'label_debits' END, fee * 3, 'shipping_labels', fee * 3 * sign FROM t WHERE kind = 2
  UNION ALL SELECT k, currency, CASE k % 12 WHEN 3 THEN 'ad_fees' WHEN 7 THEN 'sale_fees' ELSE 'other_charges' END, fee * 3 * sign, CASE k % 12 WHEN 3 THEN 'advertising' WHEN 7 THEN 'selling_fees' ELSE 'other_charges' END, fee * 3 * sign FROM t WHERE kind = 3),
w AS (SELECT m.k, m.field, m.cents, record_key, greatest(1, paid * greatest(1, quantity)) AS weight FROM m JOIN tg USING (k) JOIN rec USING (record_key) WHERE m.cents <> 0),
s AS (SELECT *, floor(cents * weight / sum(weight) OVER (PARTITION BY k, field)::DOUBLE + 0.5)::BIGINT AS share, row_number() OVER (PARTITION BY k, field ORDER BY record_key) AS r, count(*) OVER (PARTITION BY k, field) AS n FROM w),
d AS (SELECT record_key, field, CASE WHEN r = n THEN cents - coalesce(sum(share) OVER (PARTITION BY k, field ORDER BY record_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE share END AS cents FROM s),
f AS (SELECT t.k, t.currency, lt.record_key, CASE WHEN t.k % 8 < 2 THEN 'ad_fees' WHEN kind = 1 THEN 'fee_credits' ELSE 'sale_fees' END AS field, CASE WHEN t.k % 8 < 2 AND kind = 1 THEN -fee ELSE fee END AS cents, CASE WHEN t.k % 8 < 2 THEN 'advertising' ELSE 'selling_fees' END AS category,
  CASE WHEN kind = 1 THEN -fee ELSE fee END AS loose FROM t LEFT JOIN lt USING (k) WHERE kind < 2),
e AS (SELECT record_key, field, cents FROM f WHERE record_key IS NOT NULL UNION ALL SELECT record_key, field, cents FROM d),
sums AS (SELECT record_key, {sums} FROM e GROUP BY record_key)""".replace("{sums}", ", ".join(f"coalesce(sum(cents) FILTER (field = '{f}'), 0)::BIGINT AS {f}" for f in economics.FIELDS))


@query(f"WITH {_DEALT_SQL} SELECT * FROM sums")
def financial_attribution(spark, sf_dir):
    """Fees, credits, refunds, labels and charges by record, in cents."""
    return economics.attribute(_transactions(spark, sf_dir), _records(spark, sf_dir))[0]


@query(f"WITH {_DEALT_SQL} SELECT currency, category, sum(loose)::BIGINT AS cents FROM (SELECT currency, category, loose FROM f WHERE record_key IS NULL UNION ALL SELECT currency, category, loose FROM m WHERE cents <> 0 AND k NOT IN (SELECT k FROM tg)) GROUP BY 1, 2")
def unattributed_totals(spark, sf_dir):
    """What nothing sold explains, by currency and category, in cents."""
    return economics.attribute(_transactions(spark, sf_dir), _records(spark, sf_dir))[1]


@query(f"""WITH {_DEALT_SQL}, c AS (SELECT rec.*, {", ".join(f"greatest(0, coalesce({f}, 0)) AS {f}" for f in economics.FIELDS)} FROM rec LEFT JOIN sums USING (record_key))
SELECT record_key, greatest(0, sale_fees - fee_credits) AS sale_fees, ad_fees, refunds AS refund, greatest(0, label_debits - label_credits) AS label_cost, other_charges,
  paid * greatest(1, quantity) - greatest(0, sale_fees - fee_credits) - ad_fees - refunds - greatest(0, label_debits - label_credits) - other_charges AS net_cents FROM c""")
def record_net(spark, sf_dir):
    """What is left of each record's payments after all that was dealt to it, in cents."""
    records = _records(spark, sf_dir)
    return economics.net_economics(records, economics.attribute(_transactions(spark, sf_dir), records)[0])


@query("""WITH i AS (SELECT l_orderkey AS o, count(*) FILTER (l_linenumber % 3 <> 0) AS n, sum(l_quantity::BIGINT) FILTER (l_linenumber % 3 <> 0) AS q, sum(floor(l_extendedprice)::BIGINT * 100 + 25) FILTER (l_linenumber % 3 <> 0) AS c FROM lineitem GROUP BY 1)
SELECT 'O-' || o_orderkey AS order_id, o_orderdate::DATE::VARCHAR AS day, CASE WHEN o_orderkey % 4 = 0 THEN 'CANCELED' END AS cancel_state, n AS items, q::BIGINT AS quantity, c::BIGINT AS cents FROM orders JOIN i ON o = o_orderkey WHERE o_orderkey % 5 <> 0 AND n > 0""")
def sanitised_orders(spark, sf_dir):
    """Orders of a raw API payload without a buyer's data, damaged ids and line items without a title."""
    n = F.col("l_linenumber")
    cost = F.struct(F.concat(F.floor("l_extendedprice").cast("long").cast("string"), F.lit(".25")).alias("value"), F.lit("usd").alias("currency"))
    item = F.struct(F.concat(F.lit("L"), n.cast("string")).alias("lineItemId"), F.when(n % 3 != 0, F.concat(F.lit(" part "), F.col("l_partkey").cast("string"))).otherwise(" ").alias("title"), F.col("l_quantity").cast("int").alias("quantity"), cost.alias("lineItemCost"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("lineItems"))
    k = F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").join(lines, k == F.col("l_orderkey")).select(
        F.to_json(F.struct(F.when(k % 5 == 0, "bad id!?<>").otherwise(F.concat(F.lit("O-"), k.cast("string"))).alias("orderId"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("creationDate"), F.struct(F.when(k % 4 == 0, "canceled").alias("cancelState")).alias("cancelStatus"), F.struct(F.lit("a@b.example").alias("email")).alias("buyer"), "lineItems")).alias("body")
    )
    o = orders.sanitised_orders(raw, "body")
    total = lambda f: F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + i[f])
    return o.select("order_id", F.to_date("created").cast("string").alias("day"), "cancel_state", F.size("items").cast("long").alias("items"), total("quantity").alias("quantity"), total("cost_cents").alias("cents"))


@query("""SELECT 'T' || o_orderkey AS txn_id, CASE o_orderkey % 3 WHEN 0 THEN 'SALE' WHEN 1 THEN 'SHIPPING_LABEL' ELSE 'NON_SALE_CHARGE' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'O' || o_orderkey ELSE 'R' || o_orderkey END AS order_id, 'I' || o_custkey AS item_id, floor(o_totalprice)::BIGINT * 100 + 50 AS cents,
  CASE o_orderkey % 3 WHEN 1 THEN 'shipping_label' WHEN 2 THEN 'advertising' ELSE 'selling_fee' END AS category, 1 AS fees FROM orders WHERE o_orderkey % 7 <> 0""")
def sanitised_transactions(spark, sf_dir):
    """Transactions of a raw API payload: references name what they belong to, fees without a type go, memos stay behind."""
    k = F.col("o_orderkey")
    s = k.cast("string")
    money = lambda v: F.struct(v.alias("value"), F.lit("USD").alias("currency"))
    fees = F.array(F.struct(money(F.lit("1.25")).alias("amount"), F.lit("ad_fee").alias("feeType")), F.struct(money(F.lit("oops")).alias("amount"), F.lit("X").alias("feeType")), F.struct(money(F.lit("2")).alias("amount"), F.lit("").alias("feeType")))
    reference = lambda i, t: F.struct(i.alias("referenceId"), F.lit(t).alias("referenceType"))
    raw = table(spark, sf_dir, "orders").select(
        F.to_json(
            F.struct(
                F.concat(F.lit("T"), s).alias("transactionId"), F.when(k % 3 == 0, "sale").when(k % 3 == 1, "SHIPPING_LABEL").otherwise("NON_SALE_CHARGE").alias("transactionType"), F.when(k % 7 != 0, "2024-01-02T03:04:05Z").otherwise("soon").alias("transactionDate"), F.when(k % 2 == 0, F.concat(F.lit("O"), s)).alias("orderId"),
                F.when(k % 3 == 0, "FINAL_VALUE_FEE").alias("feeType"), F.when(k % 3 == 2, "Promoted listing for a buyer").alias("transactionMemo"), money(F.concat(F.floor("o_totalprice").cast("long").cast("string"), F.lit(".50"))).alias("amount"),
                F.array(F.struct(F.lit("1").alias("lineItemId"), fees.alias("marketplaceFees"))).alias("orderLineItems"), F.array(reference(F.concat(F.lit("R"), s), "ORDER_ID"), reference(F.lit("L1"), "LINE_ITEM_ID"), reference(F.concat(F.lit("I"), F.col("o_custkey").cast("string")), "ITEM_ID")).alias("references"),
            )
        ).alias("body")
    )
    t = orders.sanitised_transactions(raw, "body")
    return t.select("txn_id", "kind", "order_id", "item_id", "cents", "category", F.size(F.flatten("items.fees")).alias("fees"))

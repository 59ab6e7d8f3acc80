"""Purchase listings over the supplied tables: order lines as listings that lanes found, parts as their details, with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import purchases
from .adapters import AS_OF, spread, table
from .catalogue import query

LANES = [{"id": "all", "max_cents": 30000}, {"id": "middle", "min_cents": 3000, "max_cents": 25000}, {"id": "rings", "max_cents": 32000, "tokens": ["ring"]}]


def _listings(spark, sf_dir):
    """A listing for each order line: its title from the part, its price, shipping and state from the line, its seller from the supplier."""
    q, d, size, nation = F.col("l_quantity"), F.floor(F.col("l_discount") * 100 + 0.5), F.col("p_size"), F.col("s_nationkey")
    item_cents, ship = F.floor(F.col("l_extendedprice") / 3).cast("long"), F.floor(F.col("l_tax") * 100 + 0.5).cast("long") * 125
    dollars = lambda c: F.format_string("%d.%02d", F.floor(c / 100).cast("long"), F.pmod(c, F.lit(100)))
    quote = lambda c, kind, currency: F.struct(F.lit(kind).alias("shippingCostType"), F.struct(dollars(c).alias("value"), currency.alias("currency")).alias("shippingCost"))
    usd = F.lit("USD")
    what = F.when(size <= 5, "Vinyl LP Wall Clock").when(size <= 10, "Audio CD").when(size <= 15, "New Sealed").when(size <= 20, "12 inch").otherwise("Vinyl LP")
    balance = F.floor("s_acctbal").cast("long")
    rows = spread(table(spark, sf_dir, "lineitem")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    raw = F.struct(
        F.concat(F.lit("v1|"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"), F.lit("|0")).alias("itemId"), F.concat(F.col("p_brand"), F.lit("  - "), F.col("p_name"), F.lit(" "), what).alias("title"),
        F.when(q >= 45, F.array(F.lit("AUCTION"))).otherwise(F.array(F.lit("best_offer"), F.lit("fixed_price"))).alias("buyingOptions"), F.when(F.col("l_returnflag") == "R", "3000").otherwise("1000").alias("conditionId"),
        F.when(q >= 5, F.array(F.when(size == 50, "176984").otherwise("176985"))).alias("leafCategoryIds"), F.when(q < 5, F.array(F.struct(F.when(size >= 49, "1").otherwise("176985").alias("categoryId")))).alias("categories"),
        F.date_format(F.date_add(F.to_date("l_shipdate"), 1200), "yyyy-MM-dd'T'00:00:00'Z'").alias("itemEndDate"), F.struct(dollars(item_cents).alias("value"), F.when(nation == 3, "EUR").otherwise(usd).alias("currency")).alias("price"),
        F.when(d == 10, F.array(quote(ship, "CALCULATED", usd))).when(d < 9, F.array(quote(ship + 100, "FIXED", usd), quote(ship, "FIXED", F.when(q < 10, "CAD").otherwise(usd)))).alias("shippingOptions"),
        F.concat(F.when(nation == 9, "https://shop.example/itm/").otherwise("https://www.ebay.com/itm/"), F.col("l_partkey").cast("string")).alias("itemWebUrl"), F.struct(F.when(nation < 2, F.lit(None)).when(nation < 6, "DE").otherwise("us").alias("country")).alias("itemLocation"),
        F.struct(F.col("s_name").alias("username"), balance.alias("feedbackScore"), (F.lit(91.0) + F.pmod(balance, F.lit(100)) / 10.0).cast("decimal(5,1)").cast("string").alias("feedbackPercentage")).alias("seller"),
    )
    n = F.col("l_linenumber")
    return rows.select(F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey").alias("seen"), F.when(n <= 3, "all").when(n <= 5, "middle").otherwise("rings").alias("lane"), F.to_json(raw).alias("raw"))


def _judged(spark, sf_dir):
    return purchases.assess_items(_listings(spark, sf_dir), "raw", "lane", LANES, AS_OF, postal_code="10001")


_LISTED_SQL = f"""x AS (SELECT *, l_quantity AS q, floor(l_discount * 100 + 0.5)::BIGINT AS d, floor(l_extendedprice / 3)::BIGINT AS item_cents, floor(l_tax * 100 + 0.5)::BIGINT * 125 AS ship, floor(s_acctbal)::BIGINT AS bal,
  CASE WHEN l_linenumber <= 3 THEN 'all' WHEN l_linenumber <= 5 THEN 'middle' ELSE 'rings' END AS lane FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
y AS (SELECT *, CASE WHEN d < 9 THEN CASE WHEN q < 10 THEN ship + 100 ELSE ship END END AS shipping_cents, 910 + ((bal % 100) + 100) % 100 AS tenths FROM x),
z AS (SELECT *, item_cents + shipping_cents AS price_cents FROM y),
j AS (SELECT *, 'v1|' || l_partkey || '-' || l_suppkey || '|0' AS item_id, CASE lane WHEN 'all' THEN 1 WHEN 'middle' THEN 2 ELSE 3 END AS pos, CASE
  WHEN (q >= 5 AND p_size = 50) OR (q < 5 AND p_size >= 49) THEN 'wrong_category' WHEN q >= 45 THEN 'not_fixed_price' WHEN l_returnflag = 'R' THEN 'not_new' WHEN p_size <= 10 THEN 'non_record_title' WHEN p_size <= 15 THEN 'record_signal_missing'
  WHEN lane = 'rings' AND NOT contains(' ' || p_name || ' ', ' ring ') THEN 'lane_token_mismatch' WHEN l_shipdate::DATE + 1200 <= DATE '{AS_OF}' THEN 'unavailable' WHEN item_cents <= 0 THEN 'missing_item_price' WHEN s_nationkey = 3 THEN 'currency_mismatch'
  WHEN d = 10 THEN 'shipping_quote_not_fixed' WHEN d = 9 THEN 'shipping_unknown' WHEN lane = 'middle' AND price_cents < 3000 THEN 'below_lane_price_floor' WHEN price_cents > CASE lane WHEN 'all' THEN 30000 WHEN 'middle' THEN 25000 ELSE 32000 END THEN 'above_lane_price_ceiling'
  WHEN s_nationkey = 9 THEN 'missing_item_url' WHEN s_nationkey < 2 THEN 'item_origin_unknown' WHEN s_nationkey < 6 THEN 'cross_border_origin' WHEN bal < 0 OR tenths > 1000 THEN 'seller_reputation_missing' WHEN bal < 25 OR tenths < 970 THEN 'seller_reputation_below_threshold' END AS reject FROM z),
g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY price_cents, pos, l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey, shipping_cents) AS r, min(pos) OVER (PARTITION BY item_id) AS first_at FROM j WHERE reject IS NULL),
c AS (SELECT item_id, p_brand AS artist, p_name || ' ' || CASE WHEN p_size <= 20 THEN '12 inch' ELSE 'Vinyl LP' END AS title, price_cents, shipping_cents, s_name AS seller, bal AS seller_score, (SELECT string_agg(DISTINCT h.lane, ',' ORDER BY h.lane) FROM g h WHERE h.item_id = g.item_id) AS lanes,
  CASE first_at WHEN 1 THEN 'all' WHEN 2 THEN 'middle' ELSE 'rings' END AS first_lane, l_partkey FROM g WHERE r = 1)"""

_DETAILS_SQL = """det AS (SELECT p_partkey, CASE WHEN p_type = 'PROMO' AND p_size > 45 OR kind = 'Clock' OR form = 'Cassette' THEN 'detail_identifies_accessory'
  WHEN kind IS NOT NULL AND kind <> 'Clock' AND (form = 'Record' OR (form IS NULL AND material)) AND named AND marks >= 1 THEN NULL WHEN kind IS NULL AND form = 'Record' AND named AND marks >= 2 THEN NULL ELSE 'record_format_aspects_missing' END AS reason
  FROM (SELECT *, CASE WHEN p_size <= 8 THEN NULL WHEN p_size <= 12 THEN 'Clock' WHEN p_size <= 20 THEN 'Vinyl Record' ELSE 'LP' END AS kind, CASE WHEN cents < 70 THEN 'Record' WHEN cents < 80 THEN 'Cassette' END AS form, p_retailprice >= 1000 AS material, NOT starts_with(p_name, 'small') AS named,
    (p_type <> 'ECONOMY')::INT + (p_type <> 'STANDARD')::INT AS marks FROM (SELECT *, floor(p_retailprice * 10 + 0.5)::BIGINT % 100 AS cents FROM part)))"""


def _details(spark, sf_dir):
    """A detail for each part: aspects by its size, price, name and type."""
    size, kind, cents = F.col("p_size"), F.col("p_type"), F.floor(F.col("p_retailprice") * 10 + 0.5).cast("long") % 100
    aspect = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    aspects = [
        aspect("Type", F.when((size > 8) & (size <= 12), "Clock").when((size > 8) & (size <= 20), "Vinyl Record").when(size > 20, "LP")), aspect("Format", F.when(cents < 70, "Record").when(cents < 80, "Cassette")), aspect("Material", F.when(F.col("p_retailprice") >= 1000, "Vinyl")), aspect("Artist", F.col("p_brand")),
        aspect("Release Title", F.when(~F.startswith(F.col("p_name"), F.lit("small")), F.col("p_name"))), aspect("Catalog Number", F.when(kind != "ECONOMY", F.col("p_partkey").cast("string"))), aspect("Record Size", F.when(kind != "STANDARD", "12 inch")),
    ]
    said = F.when((kind == "PROMO") & (size > 45), F.concat(F.lit("Wall clock of "), F.col("p_name"))).otherwise(F.col("p_name"))
    raw = F.to_json(F.struct(F.array(*aspects).alias("localizedAspects"), said.alias("shortDescription")))
    return purchases.assess_details(spread(table(spark, sf_dir, "part")).select("p_partkey", raw.alias("raw")), "raw")


@query(f"WITH {_LISTED_SQL} SELECT lane, CASE WHEN reject IS NOT NULL THEN reject WHEN pos = first_at AND k = 1 THEN 'accepted' ELSE 'duplicate' END AS outcome, count(*) AS n FROM (SELECT j.lane, j.reject, j.pos, first_at, k FROM j LEFT JOIN (SELECT item_id, pos AS a, l_orderkey AS o, l_linenumber AS l, l_extendedprice AS e, first_at, row_number() OVER (PARTITION BY item_id, pos ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS k FROM g) f ON j.item_id = f.item_id AND j.pos = f.a AND j.l_orderkey = f.o AND j.l_linenumber = f.l AND j.l_extendedprice = f.e AND j.reject IS NULL) GROUP BY 1, 2")
def purchase_lanes(spark, sf_dir):
    """What became of the listings of each lane: accepted, duplicate or the first rule broken, counted."""
    return purchases.discover(_judged(spark, sf_dir), "lane", LANES, "seen")[1]


@query(f"WITH {_LISTED_SQL} SELECT item_id, artist, title, price_cents, shipping_cents, seller, seller_score, lanes, first_lane FROM c")
def purchase_candidates(spark, sf_dir):
    """One candidate for each item that passes all rules: its cheapest listing and the lanes that found it."""
    found = purchases.discover(_judged(spark, sf_dir), "lane", LANES, "seen")[0]
    return found.select("item_id", "artist", "title", "price_cents", "shipping_cents", "seller", "seller_score", F.array_join("lanes", ",").alias("lanes"), "first_lane")


@query(f"WITH {_DETAILS_SQL} SELECT p_partkey, CASE WHEN reason IS NULL THEN 'verified' WHEN reason = 'detail_identifies_accessory' THEN 'rejected' ELSE 'unknown' END AS status, reason FROM det")
def purchase_details(spark, sf_dir):
    """What each part's detail says it is."""
    return _details(spark, sf_dir).select("p_partkey", "status", "reason")


@query(f"WITH {_LISTED_SQL}, {_DETAILS_SQL} SELECT item_id, price_cents, CASE WHEN reason IS NULL THEN 'detail_aspects' ELSE 'summary_only' END AS identity, CASE WHEN reason IS NULL THEN 'official_api' ELSE 'discovery_lead' END AS offer FROM c JOIN det ON p_partkey = l_partkey WHERE reason IS DISTINCT FROM 'detail_identifies_accessory'")
def purchase_offers(spark, sf_dir):
    """Candidates after their details were read: accessories gone, identities verified where the aspects say so."""
    found = purchases.discover(_judged(spark, sf_dir), "lane", LANES, "seen")[0]
    details = _details(spark, sf_dir).withColumn("part", F.col("p_partkey").cast("string"))
    keyed = found.select("item_id", F.regexp_extract("item_id", r"\|(\d+)-", 1).alias("part")).join(details, "part").select("item_id", "status", "evidence")
    return purchases.with_details(found, keyed).select("item_id", "price_cents", "identity", "offer")

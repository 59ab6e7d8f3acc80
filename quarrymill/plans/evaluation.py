"""The evaluation of finds over the supplied tables, and the candidate gate, each with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import candidates
from ..operators import evaluation
from .adapters import AS_OF, SOLD_SQL, round_sql, sold_lines, table
from .catalogue import query

r = round_sql


def _finds(spark, sf_dir):
    """Parts as finds: their own sold lines are the evidence; what the tables lack follows from size, brand and type."""
    sold = sold_lines(spark, sf_dir)
    window = lambda n: F.coalesce(F.sum(F.when(F.col("age").between(0, n), F.col("units"))), F.lit(0)).cast("double")
    latest = F.max(F.when((F.col("units") > 0) & F.col("age").isNotNull(), F.to_date("sale_date")))
    u = sold.groupBy("item").agg(window(30).alias("u30"), window(90).alias("u90"), window(365).alias("u365"), window(1095).alias("u1095"), latest.alias("latest"), F.count_distinct("source").cast("double").alias("sources"))
    p = table(spark, sf_dir, "part").join(u, F.col("p_partkey") == F.col("item"))
    n, brand = F.col("p_size"), F.col("p_brand")
    now = F.lit(AS_OF).cast("timestamp")
    before = lambda days: (now - F.make_dt_interval(days)).cast("timestamp")
    every = lambda k: n % k == 0
    price = F.floor(F.col("p_retailprice") + 0.5) / 100.0
    resale = F.floor(F.col("p_retailprice") * (1 + n / 12.0) + 0.5) / 100.0
    used = F.col("p_type") == "PROMO"
    return p.select(
        F.col("p_partkey").alias("id"), F.when(every(10), "Unknown Artist").otherwise(F.col("p_name")).alias("artist"), F.when(used, "used VG").when(F.col("p_type") == "SMALL", "").otherwise("new/sealed").alias("condition"),
        F.when(every(2), "x").alias("barcode"), price.alias("purchase_price"), F.when(every(13), price - 1).alias("lowest_active_price"),
        F.when(brand == "Brand#1", "eur").when(brand != "Brand#2", "USD").alias("source_currency"), F.when((brand == "Brand#2") & every(2), "UK").alias("source_country"), F.lit(1.25).alias("conversion_rate"), before(n).alias("conversion_at"),
        before(n % 4).alias("captured_at"), F.when(every(7), "discovery_lead").otherwise(" Direct_Retailer").alias("offer_verification"), F.when(brand == "Brand#3", "avoid").when(brand == "Brand#4", "prefer").alias("preference"),
        n.cast("double").alias("artist_units_365"), (n * 2).cast("double").alias("artist_units_1095"), F.when(every(5), n / 50.0).alias("external_evergreen"), every(9).alias("best_seller"), (n * 10).cast("double").alias("review_count"),
        F.when(every(6), 15.0).alias("source_min_net"), F.struct(F.when(every(3), 0.0).alias("inbound_shipping")).alias("costs"),
        F.struct(
            before(n).alias("captured_at"), F.when(used, "used").otherwise("new_sealed").alias("condition"), F.when(~every(11), resale).alias("resale_price"), F.col("latest").alias("latest_sale"),
            F.when(every(8), "medium").when(n % 16 == 1, "low").otherwise("high").alias("match_confidence"), F.when(every(17), "research").otherwise("local-own-sales-history").alias("source"),
            F.when(every(19), "pending").otherwise("validated").alias("status"), F.col("u30").alias("units_30"), F.col("u90").alias("units_90"), F.col("u365").alias("units_365"), F.col("u1095").alias("units_1095"),
        ).alias("sold"),
        F.struct(before(n).alias("captured_at"), F.when(~every(23), F.greatest(F.lit(0.0), F.col("sources") - 20)).alias("exact_count"), F.lit("high").alias("match_confidence"), F.lit(True).alias("complete"), F.lit("available").alias("status")).alias("active"),
    )


_RANK = "CASE WHEN x <= 1 THEN 20.0 WHEN x <= 3 THEN 17.0 WHEN x <= 6 THEN 13.0 WHEN x <= 12 THEN 8.0 WHEN x <= 24 THEN 3.0 ELSE 0.0 END"
EVALUATION_SQL = f"""
WITH {SOLD_SQL},
u AS (SELECT item, coalesce(sum(units) FILTER (age BETWEEN 0 AND 90), 0)::DOUBLE AS u90, coalesce(sum(units) FILTER (age BETWEEN 0 AND 365), 0)::DOUBLE AS u365,
  coalesce(sum(units) FILTER (age BETWEEN 0 AND 1095), 0)::DOUBLE AS u1095, min(age) FILTER (units > 0) AS sale_age, count(DISTINCT source) AS sources FROM sold GROUP BY item),
a AS (SELECT p_partkey AS id, p_size AS n, p_brand AS brand, p_type AS kind, u90, u365, u1095, sale_age, floor(p_retailprice + 0.5) / 100.0::DOUBLE AS price,
  CASE WHEN p_size % 11 <> 0 THEN floor(p_retailprice * (1 + p_size / 12.0::DOUBLE) + 0.5) / 100.0::DOUBLE END AS resale,
  CASE WHEN p_size % 23 <> 0 THEN greatest(0, sources - 20)::DOUBLE END AS active FROM part JOIN u ON item = p_partkey),
b AS (SELECT *, brand IN ('Brand#1', 'Brand#2') AS foreign_, brand = 'Brand#2' AND n % 2 = 1 AS no_currency, n <= 30 AS fresh30,
  CASE WHEN n % 8 = 0 THEN 0.65 WHEN n % 16 = 1 THEN 0.3 ELSE 1.0 END AS sc,
  n % 17 <> 0 AS valid, kind <> 'SMALL' AS same_condition FROM a),
c AS (SELECT *, foreign_ AND (no_currency OR NOT fresh30) AS withheld, CASE WHEN foreign_ AND fresh30 AND NOT no_currency THEN {r("price * 1.25")} ELSE price END AS paid FROM b),
d AS (SELECT *, CASE WHEN NOT withheld THEN resale END AS res, {r("paid * (9.5 / 100)")} AS tax FROM c),
e AS (SELECT *, {r("paid + tax + CASE WHEN n % 3 = 0 THEN 0 ELSE 5 END")} AS landed_cost,
  {r(f"coalesce({r('res * 0.15 + 0.3')}, 0) + coalesce({r('res * 0.02')}, 0) + 6 + 1 + coalesce({r('res * 0.03')}, 0)")} AS selling_costs FROM d),
f AS (SELECT *, {r("landed_cost + selling_costs")} AS total_cost FROM e),
g AS (SELECT *, {r("res - total_cost")} AS net_profit FROM f),
h AS (SELECT *, {r("net_profit / landed_cost", 4)} AS roi, CASE WHEN res > 0 THEN {r("net_profit / res", 4)} END AS margin,
  CASE WHEN u90 + active > 0 THEN {r("u90 / (u90 + active)", 4)} WHEN u90 + active = 0 THEN 0 END AS sell_through, {r("u90 / 3")} AS spm, {r("u1095 / 36")} AS lpm FROM g),
i AS (SELECT *, CASE WHEN spm > 0 THEN {r("active / spm")} END AS months, CASE WHEN lpm > 0 THEN {r("active / lpm")} END AS long_months FROM h),
j AS (SELECT *, CASE WHEN active = 0 AND (spm > 0 OR lpm > 0) THEN 7.0 ELSE greatest(7.0, floor(coalesce(months, long_months) * 30 + 0.5)) + coalesce(months, long_months) * 0 END AS days FROM i),
k AS (SELECT *, {r("net_profit * (30 / days)")} AS per30,
  (CASE WHEN n >= 20 THEN 2 WHEN n >= 8 THEN 1 ELSE 0 END) + (CASE WHEN 2 * n >= 60 THEN 2 WHEN 2 * n >= 24 THEN 1 ELSE 0 END) + (CASE WHEN u1095 >= 24 AND lpm >= 0.67 THEN 2 ELSE 0 END)
  + (CASE WHEN n % 5 <> 0 THEN 0 WHEN n / 50.0::DOUBLE >= 0.8 THEN 2 WHEN n / 50.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END) + (CASE WHEN brand = 'Brand#4' THEN 1 ELSE 0 END) AS strength,
  n % 19 <> 0 AND sale_age IS NOT NULL AND valid AND same_condition AS sold_ok, n % 23 <> 0 AS active_ok, sc >= 0.8 AS sure, n % 4 <= 2 AS offer_ok, n % 7 <> 0 AS verified FROM j),
l AS (SELECT *, CASE WHEN strength >= 2 THEN 'strong' WHEN strength = 1 THEN 'moderate' ELSE 'none' END AS evergreen,
  sold_ok AND sure AND fresh30 AND offer_ok AND NOT withheld AND coalesce(resale >= 10, false) AS ready, coalesce(active <= 50 AND days <= 270, false) AS supply,
  valid AND coalesce(u90 >= 6 AND spm >= 2 AND sale_age <= 45 AND sell_through >= 0.3 AND days <= 45, false) AS quick,
  valid AND coalesce(u90 >= 3 AND spm >= 1 AND sale_age <= 60 AND sell_through >= 0.2 AND days <= 120, false) AS steady,
  valid AND coalesce(u365 >= 6 AND sale_age <= 120 AND coalesce(days <= 270, long_months * 30 <= 270) AND lpm >= 0.15, false) AS slow FROM k),
m AS (SELECT *, valid AND coalesce(sale_age <= 365 AND (u365 >= 1 OR evergreen = 'strong') AND days <= 540, false) AS partly,
  steady AND NOT quick AND evergreen = 'strong' AND coalesce(months <= 3, false) AS flexible, coalesce(days > 120, false) OR coalesce(months > 6, false) AS lagging FROM l),
o AS (SELECT *, 4.0::DOUBLE AS n1, 0.2::DOUBLE AS r1, CASE WHEN flexible THEN 5.6 ELSE 7.0 END::DOUBLE AS n2, CASE WHEN flexible THEN 0.24 ELSE 0.3 END::DOUBLE AS r2,
  (CASE WHEN n % 6 = 0 THEN 15 ELSE 12 END + CASE WHEN lagging THEN 2 ELSE 0 END + CASE WHEN lagging AND evergreen = 'none' THEN 1 ELSE 0 END)::DOUBLE AS n3,
  (CASE WHEN lagging AND evergreen = 'none' THEN 0.6 WHEN lagging THEN 0.55 ELSE 0.5 END)::DOUBLE AS r3 FROM m),
q AS (SELECT *, coalesce(net_profit >= n1 AND roi >= r1, false) AS g1, coalesce(net_profit >= n2 AND roi >= r2, false) AS g2, coalesce(net_profit >= n3 AND roi >= r3, false) AS g3,
  coalesce(net_profit >= n3 * 0.75 AND roi >= r3 * 0.75, false) AS near3 FROM o),
s AS (SELECT *, ready AND coalesce(net_profit >= 0, false) AND quick AND NOT g1 AS w1, ready AND coalesce(net_profit >= 0, false) AND steady AND NOT g2 AS w2,
  ready AND coalesce(net_profit >= 0, false) AND ((slow AND NOT g3) OR (NOT slow AND partly AND (g3 OR near3))) AS w3,
  CASE WHEN ready AND quick AND g1 THEN 'fast_turn' WHEN ready AND steady AND g2 THEN 'balanced' WHEN ready AND slow AND g3 THEN 'high_margin' END AS strategy,
  quick OR steady OR slow AS demand, g1 OR g2 OR g3 AS economics FROM q),
cents AS (SELECT id, res, n, selling_costs, (quick OR w1) AS a1, (steady OR w2) AS a2, (slow OR w3) AS a3, n1, r1, n2, r2, n3, r3, unnest(range(0, floor(res * 100)::BIGINT + 1)) / 100.0::DOUBLE AS p FROM s WHERE res IS NOT NULL AND (quick OR w1 OR steady OR w2 OR slow OR w3)),
landed AS (SELECT *, {r(f"p + {r('p * (9.5 / 100)')} + CASE WHEN n % 3 = 0 THEN 0 ELSE 5 END")} AS l FROM cents),
gain AS (SELECT *, {r(f"res - {r('l + selling_costs')}")} AS g FROM landed),
tops AS (SELECT id, max(p) AS top FROM gain WHERE l > 0 AND ((a1 AND g >= n1 AND {r("g / l", 4)} >= r1) OR (a2 AND g >= n2 AND {r("g / l", 4)} >= r2) OR (a3 AND g >= n3 AND {r("g / l", 4)} >= r3)) GROUP BY id),
t AS (SELECT s.*, CASE WHEN res IS NOT NULL THEN coalesce(top, 0.0) END AS max_price,
  least(30.0, {r("least(12.0, greatest(0.0, coalesce(spm / 4, 0) * 12)) + least(8.0, greatest(0.0, coalesce(u365 / 12, 0) * 8)) + least(6.0, greatest(0.0, coalesce(lpm, 0) * 6)) + CASE WHEN sale_age <= 30 THEN 4 WHEN sale_age <= 60 THEN 3 WHEN sale_age <= 120 THEN 2 WHEN sale_age <= 365 THEN 1 ELSE 0 END", 1)}) AS pd,
  CASE WHEN withheld THEN 0 ELSE least(30.0, {r("CASE WHEN net_profit >= 0 THEN least(20.0, net_profit / 12 * 20) ELSE 0 END + CASE WHEN roi >= 0 THEN least(8.0, roi / 0.6 * 8) ELSE 0 END + CASE WHEN per30 >= 0 THEN least(2.0, per30 / 8 * 2) ELSE 0 END", 1)}) END AS pe,
  CASE WHEN NOT (sold_ok AND (spm > 0 OR lpm > 0)) THEN 0.0 WHEN active = 0 THEN 20.0 ELSE {_RANK.replace("x", "coalesce(months, long_months)")} END AS ps,
  least(15.0, {r("least(6.0, n / 20.0::DOUBLE * 6) + least(2.0, (n * 2) / 60.0::DOUBLE * 2) + least(4.0, coalesce(lpm, 0) * 4) + CASE WHEN n % 9 = 0 THEN 1.5 ELSE 0 END + least(0.5, log10(1.0 + n * 10) / 3) + CASE WHEN n % 5 = 0 THEN n / 50.0::DOUBLE ELSE 0 END * 4 + CASE WHEN brand = 'Brand#4' THEN 5 ELSE 0 END", 1)}) AS pv,
  (sold_ok::INT + active_ok::INT + sure::INT + (fresh30 AND offer_ok)::INT + (n % 2 = 0)::INT)::DOUBLE AS pq FROM s LEFT JOIN tops USING (id)),
v AS (SELECT *, floor(ps + pd + pe + pv + pq + 0.5)::BIGINT AS s0 FROM t),
w AS (SELECT *, CASE WHEN n % 10 = 0 THEN greatest(0, s0 - 3) ELSE s0 END AS s1 FROM v),
x AS (SELECT *, CASE WHEN withheld THEN greatest(0, s1 - 3) ELSE s1 END AS s2 FROM w),
y AS (SELECT *, CASE WHEN brand = 'Brand#3' THEN least(49, s2) ELSE s2 END AS score FROM x),
z AS (SELECT *, list_filter([CASE WHEN NOT withheld AND coalesce(net_profit < 0 OR roi < 0, false) THEN 'ECONOMICS_HARD_FAIL' END, CASE WHEN active_ok AND sold_ok AND coalesce(active > 50 AND days > 270, false) THEN 'SUPPLY_HARD_FAIL' END,
    CASE WHEN NOT withheld AND active_ok AND n % 13 = 0 AND price - 1 > 0 AND price - 1 <= paid THEN 'ACTIVE_MARKET_BELOW_BUY_COST' END], lambda e: e IS NOT NULL) AS hard,
  [CASE WHEN NOT fresh30 THEN 'EVIDENCE_STALE_OR_UNDATED' END, CASE WHEN NOT offer_ok THEN 'OFFER_STALE_OR_UNDATED' END] AS old,
  [CASE WHEN NOT demand THEN 'DEMAND_GATE_FAILED' END, CASE WHEN NOT supply THEN 'SUPPLY_GATE_FAILED' END, CASE WHEN NOT economics THEN 'ECONOMICS_GATE_FAILED' END, CASE WHEN NOT sure THEN 'MATCH_CONFIDENCE_GATE_FAILED' END] AS failed,
  CASE WHEN w1 THEN quick WHEN w2 THEN steady WHEN w3 THEN slow END AS watch_demand, sure AND coalesce(resale >= 10, false) AND coalesce(max_price > 0, false) AS watchable FROM y),
zz AS (SELECT *, list_filter(list_concat([CASE WHEN no_currency THEN 'SOURCE_CURRENCY_UNKNOWN' WHEN withheld THEN 'SOURCE_CURRENCY_UNCONVERTED' END, CASE WHEN NOT sold_ok THEN 'SOLD_EVIDENCE_INCOMPLETE' END, CASE WHEN NOT valid THEN 'SOLD_VELOCITY_UNVALIDATED' END,
    CASE WHEN NOT active_ok THEN 'ACTIVE_EVIDENCE_INCOMPLETE' END], old, [CASE WHEN NOT verified THEN 'ACQUISITION_OFFER_UNVERIFIED' END, CASE WHEN NOT same_condition THEN 'SOLD_CONDITION_MISMATCH' END,
    CASE WHEN sc < 0.8 THEN 'SOLD_MATCH_CONFIDENCE_LOW' END, CASE WHEN resale IS NULL THEN 'CONSERVATIVE_RESALE_MISSING' END]), lambda e: e IS NOT NULL) AS missing FROM z),
verdict AS (SELECT *, CASE WHEN len(hard) > 0 THEN 'REJECT' WHEN brand = 'Brand#3' THEN 'REJECT' WHEN len(missing) > 0 THEN CASE WHEN sc < 0.5 THEN 'REJECT' ELSE 'REVIEW' END WHEN strategy IS NOT NULL AND score >= 65 THEN 'BUY'
    WHEN strategy IS NOT NULL AND score >= 50 THEN 'REVIEW' WHEN strategy IS NOT NULL THEN 'WATCH' WHEN watch_demand IS NOT NULL AND watchable THEN 'WATCH' ELSE 'REJECT' END AS decision,
  CASE WHEN len(hard) > 0 THEN list_concat(hard, old) WHEN brand = 'Brand#3' THEN ['USER_AVOID_PREFERENCE'] WHEN len(missing) > 0 THEN missing
    WHEN strategy IS NOT NULL THEN [CASE WHEN score >= 65 THEN 'ADAPTIVE_STRATEGY_PASSED' WHEN score >= 50 THEN 'TEST_ONE_OPTION' ELSE 'LOW_PRIORITY_WATCH' END, 'STRATEGY_' || upper(strategy)]
    WHEN watch_demand IS NOT NULL AND watchable THEN list_concat(failed, [CASE WHEN watch_demand THEN 'PRICE_TARGET_WATCH' ELSE 'SLOW_DEMAND_HIGH_MARGIN_WATCH' END]) ELSE failed END AS codes FROM zz)
SELECT id, decision, array_to_string(list_filter(codes, lambda e: e IS NOT NULL), ',') AS reason_codes, score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'REJECT' END AS band, strategy,
  net_profit, roi, margin, landed_cost, selling_costs, total_cost, sell_through::DOUBLE AS sell_through, spm AS sales_per_month, months AS supply_months, lpm AS long_per_month, long_months AS long_supply_months, days::DOUBLE AS days_to_sell, per30 AS profit_per_30, max_price::DOUBLE AS max_price, evergreen,
  pd::DOUBLE AS points_demand, pe::DOUBLE AS points_economics, ps::DOUBLE AS points_supply, pv::DOUBLE AS points_evergreen, pq AS points_evidence, active_ok AS active_evidence, demand, economics, sure AS confident, fresh30 AS market_fresh, offer_ok AS offer_fresh, verified AS offer_verified,
  sold_ok AS sold_evidence, supply, withheld AS conversion_required FROM verdict"""


@query(EVALUATION_SQL)
def find_evaluation(spark, sf_dir):
    """Decision, reason codes, score, gates and numbers of every part as a find."""
    return evaluation.evaluate(_finds(spark, sf_dir), f"{AS_OF} 00:00:00")


# ---- the candidate gate ------------------------------------------------------------------------------

_ENDINGS = ["vinyl LP", "- Album", "CD", "koozie - Edition", "wall clock vinyl", "guitar picks - Mono", "shampoo", "12\" Soundtrack", "flac : Stereo", "used LP", "turntable mat"]


def _listings(spark, sf_dir):
    """Listings whose titles are opening lines with an ending that says what is sold."""
    k = F.col("doc_id")
    ending = F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (k % len(_ENDINGS) + 1).cast("int"))
    name = F.concat_ws(" ", F.substring_index("text", "\n", 1), ending)
    url = F.when(k % 5 == 0, F.concat(F.lit("https://shop.example.com/products/"), k.cast("string"))).when(k % 5 == 1, F.lit("https://shop.example.com/collections/used-vinyl")).when(k % 5 == 2, F.lit("https://b.example/p/?ean=9781234567890")).when(k % 5 == 3, F.lit("https://s.example/items/a-digital-album?x=1")).otherwise("https://shop.example.com/about")
    d = table(spark, sf_dir, "documents")
    return d.select(k.alias("id"), name.alias("title"), url.alias("url"), F.when(k % 7 == 0, "Walmart").when(k % 7 == 1, "Cheap Vinyl").when(k % 7 == 2, "Record Shop").otherwise("Outlet").alias("shop"), F.when(k % 4 == 0, "shoes and toys").alias("context"))


def _has(text: str, words: str) -> str:
    """Whether one of the words (a regular expression each) stands in a text as a whole."""
    return f"regexp_matches({text}, '(?i)\\b(?:{words})\\b')"


# The gate in SQL: word lists as an enumeration of goods, read off the survey; written apart from the operator's tables.
_MEDIA = (
    "4k\\s+uhd|uhd|blu[\\s-]?ray|dvd|steelbook|(?:\\d+\\s*x?\\s*)?cds?|compact\\s+disc|cassette|book|magazine|zine|calendar|poster|sticker|patch|pin|keychain|wallet|tote|bag|hat|hoodie|shirt|t[\\s-]?shirts?|tee|sweatshirt|socks|jewelry|earrings?|"
    "necklace|mug|bottle|koozie|ornament|blanket|placemat|pizza\\s+cutter|figurine|trading\\s+card|gift\\s+card|guitar\\s+picks?|slip\\s*mat|record\\s+players?|turntables?|deck\\s+bundle|merch(?:andise)?\\s+bundle"
)
_GOODS = (
    "air\\s+fryer|apparel|automotive|baby|bathing\\s+suits?|beauty|bedding|bicycles?|bikinis?|bra(?:lette)?|bucket|cable|car\\s+wash|cat\\s+treats?|charger|cleaning|clothing|coffee|comforter|coolers?|cosmetics|decorations?|dish\\s+soap|electronics?|"
    "eyeshadow|fitness\\s+tracker|food|gimmicks?|goggles|granola|grocery|groceries|hair|handbags?|headphones?|ice\\s+packs?|kitchen|knife|laundry|laptop|makeup|manicure|mattress|nail\\s+colou?r|ornament|pants|paprika|pencils?|pens?|phone|protein|purse|"
    "sauce|screwdrivers?|shampoo|shoes?|shorts|skin\\s*care|smart\\s*watch|smartwatch|snacks?|speaker|supplement|swimdress|swimsuits?|swimwear|tablet|toothpaste|toys?|tuna|underwear|webcam|wipes?"
)
_PARTS = (
    "stylus|needle|cartridge|45\\s+adapter|(?:inner|outer)\\s+sleeves?|replacement\\s+(?:cover|jacket|sleeve|stylus)|(?:platter|turntable(?:\\s+platter)?)\\s+mat|slip\\s*mat|record\\s+(?:bowl|cleaner)|cleaning\\s+(?:brush|fluid|kit)|storage\\s+crate|"
    "display\\s+frame|wall\\s+clock|coasters?|decal|label\\s+decal|paper\\s+label|non[- ]?adhesive\\s+label"
)
_MADE = (
    "wall\\s+(?:art|clock|decor)|drink\\s+coasters?|coasters?\\s+(?:set|pack)|(?:tote|canvas|shoulder|shopping)\\s+bags?|earrings?|cufflinks?|keychains?|jewel(?:ry|lery)|phone\\s+case|decal|non\\s+adhesive\\s+label|paper\\s+label|platter\\s+mat|record\\s+bowl|"
    "replacement\\s+(?:cover|jacket|sleeve)|slip\\s*mat|turntable\\s+(?:platter\\s+)?mat|(?:made|crafted|cut)\\s+from\\s+(?:an?\\s+)?(?:recycled|upcycled)\\s+(?:vinyl\\s+)?records?|"
    "(?:vinyl|record|lp)\\b.{0,40}\\b(?:bowl|floor\\s+mat|mouse\\s+mat|record\\s+mat)|(?:bowl|floor\\s+mat|mouse\\s+mat)\\b.{0,40}\\b(?:vinyl|record|lp)"
)
_BARE = "all|back|browse|cart|clearance|contact|deals?|discover|explore|featured|filter\\s+amazon(?:\\s+by\\s+price)?|home|learn\\s+more|log\\s*in|lps?|menu|more|new|new\\s+releases|next|previous|records?|sale|search|shop|shop\\s+(?:all|now)|sign\\s+in|specials?|view\\s+(?:all|details|more)|vinyl"
_ENDING_SQL = "[" + ", ".join("'" + e + "'" for e in _ENDINGS) + "]"
GATE_SQL = f"""
WITH l AS (SELECT doc_id AS id, doc_id AS k, trim(regexp_replace(split_part(text, chr(10), 1) || ' ' || {_ENDING_SQL}[doc_id % {len(_ENDINGS)} + 1], '\\s+', ' ', 'g')) AS t,
  CASE doc_id % 5 WHEN 0 THEN '/products/' || doc_id WHEN 1 THEN '/collections/used-vinyl' WHEN 2 THEN '/p/' WHEN 3 THEN '/items/a-digital-album' ELSE '/about' END AS path,
  CASE WHEN doc_id % 4 = 0 THEN 'shoes and toys' ELSE '' END AS context FROM documents),
e AS (SELECT *, t || ' ' || trim(regexp_replace(path, '[-_/]+', ' ', 'g')) AS every,
  regexp_matches(t, '(?i)\\b(?:vinyl|phonograph\\s+record|record\\s+album|(?:[1-9]\\s*(?:[x×-]\\s*)?)?lp|ep|(?:7|10|12)\\s*inch)\\b') OR regexp_matches(t, '(?i)\\b(?:7|10|12)\\s*(?:in\\.|["”])[0-9a-z_]') AS explicit,
  regexp_matches(t, '\\s[-–—:|]\\s') OR {_has("t", "album|anniversary|audiophile|edition|exclusive|gatefold|mono|remaster(?:ed)?|soundtrack|stereo")} AS shaped,
  k % 5 IN (0, 2, 3) AS product, k % 7 = 0 AS walmart, k % 7 = 1 AS cheap, k % 7 IN (1, 2) AS focused FROM l),
g AS (SELECT *, CASE
  WHEN length(t) < 3 THEN 'title_too_short'
  WHEN regexp_matches(t, '(?i)^(?:{_BARE})[\\s!→›»]*$') THEN 'navigation_label'
  WHEN k % 5 = 1 AND false OR {_has("every", "open[\\s-]?box|scratch\\s+and\\s+dent|shopworn")} OR {_has("every", "(?:damaged|used|pre[-\\s]?owned)\\s+(?:copy|lp|record|vinyl)")} OR regexp_matches(every, '(?i)^\\s*[\\[(]?\\s*damaged\\b') THEN 'non_new_condition'
  WHEN {_has("regexp_replace(every, '[^A-Za-z0-9]+', ' ', 'g')", _MADE)} OR {_has("every", _PARTS)} THEN 'record_accessory'
  WHEN walmart AND NOT explicit THEN 'marketplace_requires_explicit_vinyl'
  WHEN k % 5 = 2 THEN 'isbn_book_listing'
  WHEN cheap AND NOT explicit AND NOT shaped THEN 'deal_aggregator_requires_record_title'
  WHEN k % 5 = 3 THEN 'digital_only_product'
  WHEN {_has("every", _MEDIA)} THEN 'non_vinyl_format'
  WHEN {_has("t", "digital|download|flac|mp3|streaming|wav")} AND NOT explicit THEN 'non_vinyl_format'
  WHEN {_has("every", _GOODS)} AND NOT explicit THEN 'non_music_retail_category'
  WHEN regexp_matches(t, '(?i)^(?:bogo|buy\\s+(?:one|1)|extra\\s+\\d|free\\s+shipping|get\\s+(?:one|1)|members?\\s+only|prime\\s+members?|save\\s+\\d|select\\s+(?:accounts?|items?|titles?)|up\\s+to\\s+\\d|\\d+\\s*%\\s*off)\\b') AND NOT shaped THEN 'promotion_label'
  WHEN NOT explicit AND NOT shaped AND context <> '' THEN 'non_music_retail_context'
  WHEN NOT explicit AND NOT product THEN 'no_product_or_format_signal'
  WHEN NOT explicit AND NOT focused AND NOT shaped THEN 'weak_record_signal' END AS reject FROM e)
SELECT id, reject, (CASE WHEN reject IS NULL THEN 20 + CASE WHEN explicit THEN 35 ELSE 0 END + CASE WHEN product THEN 15 ELSE 0 END + CASE WHEN shaped THEN 8 ELSE 0 END + CASE WHEN focused THEN 8 ELSE 0 END ELSE 0 END)::DOUBLE AS score FROM g"""


def _gate(spark, sf_dir):
    rows = _listings(spark, sf_dir)
    out = candidates.assess("title", F.lit(""), F.lit(""), "context", "url", {"name": "shop"})
    return rows.select("id", out["reject"].alias("reject"), out["score"].alias("score"))


@query(GATE_SQL)
def candidate_assessment(spark, sf_dir):
    """First reject reason or score of listings whose titles are whole opening lines."""
    return _gate(spark, sf_dir)


@query(GATE_SQL)
def candidate_assessment_whole(spark, sf_dir):
    """The same under the name that it has had."""
    return _gate(spark, sf_dir)

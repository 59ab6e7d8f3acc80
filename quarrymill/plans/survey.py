"""Queries of the Column functions and small operators, each over the supplied tables and each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decisions, listings, money, text, urls
from ..operators import aggregates, ranking
from ..operators import listings as tables
from ..sources import catalogs, html, payloads
from ..sources import tables as files
from .adapters import AS_OF, SOLD_SQL, round_sql, sold_lines, spread, table
from .catalogue import query

# ---- titles ------------------------------------------------------------------------------------------

_TAILS = [" LP Limited Edition 180g", " 2xLP Red Vinyl Deluxe", " Target Exclusive Marbled", " 10th Anniversary Mono", " Used VG+/NM record", " (Remastered) Stereo Sealed 1979"]


def _titles(spark, sf_dir):
    tail = F.element_at(F.array(*[F.lit(t) for t in _TAILS]), F.col("p_size") % 6 + 1)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.col("p_brand"), F.lit(" & The "), F.col("p_name"), F.lit(" - "), F.col("p_type"), tail).alias("title"))


_T = "t AS (SELECT p_partkey AS id, p_brand || ' & The ' || p_name || ' - ' || p_type || [{}][p_size % 6 + 1] AS title FROM part)".format(", ".join(f"'{t}'" for t in _TAILS))
_STOP = "('the','a','an','lp','vinyl','record','records','album','used')"
_WORDS = "list_filter(regexp_split_to_array(regexp_replace(replace(lower({}), '&', ' and '), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '' AND x NOT IN " + _STOP + ")"
_STRIPPED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?i)\\b(?:factory\\s+sealed|brand\\s+new|new\\s+sealed|sealed)\\b', ' ', 'g'), '\\bVG\\+/NM\\b', ' ', 'g'), '(?i)\\bvinyl\\s+record\\b', ' ', 'g'), '\\b\\d{{4}}\\b', ' ', 'g'), '(?i)\\b\\d+\\s*(?:gram|grams|g)\\b', ' ', 'g')"


@query(
    f"""WITH {_T}, w AS (SELECT id, title, {_WORDS.format("title")} AS w, {_WORDS.format(_STRIPPED.format("title"))} AS s FROM t)
SELECT id, array_to_string(w, ' ') AS normalised, array_to_string(list_filter(w, lambda x: length(x) >= 3 AND x NOT IN ('album','and','lp','record','records','stereo','the','vinyl')), ' ') AS searched,
  array_to_string(list_filter(s, lambda x: x NOT IN ('pressing','press','edition','limited','remastered','stereo')), ' ') AS library FROM w"""
)
def title_forms(spark, sf_dir):
    """Titles as words, as search words and as the library's key text."""
    t = _titles(spark, sf_dir)
    return t.select("id", text.normalise_title("title").alias("normalised"), F.array_join(text.query_words("title"), " ").alias("searched"), text.normalise_sold_library("title").alias("library"))


@query(
    f"""WITH {_T}, e AS (SELECT id, list_sort(list_distinct(list_filter([CASE WHEN title LIKE '%10th Anniversary%' THEN 'anniversary-10' END, CASE WHEN title LIKE '% 2xLP%' THEN '2lp' END, CASE WHEN title LIKE '%180g%' THEN '180g' END,
  CASE WHEN title LIKE '%Deluxe%' THEN 'deluxe' END, CASE WHEN title LIKE '%Limited%' THEN 'limited' END, CASE WHEN title LIKE '%Mono' THEN 'mono' END, CASE WHEN title LIKE '%Remastered%' THEN 'remastered' END, CASE WHEN title LIKE '%Stereo%' THEN 'stereo' END,
  CASE WHEN title LIKE '%Target Exclusive%' THEN 'exclusive-target' END, CASE WHEN title LIKE '%Red Vinyl%' THEN 'color-red' END, CASE WHEN title LIKE '%Marbled%' THEN 'texture-marble' END], lambda x: x IS NOT NULL))) AS s FROM t)
SELECT id, CASE WHEN len(s) = 0 THEN 'standard' ELSE array_to_string(s, ',') END AS edition FROM e"""
)
def edition_identities(spark, sf_dir):
    """Editions that titles name, as one sorted identity."""
    return spread(_titles(spark, sf_dir)).select("id", text.edition_identity("title").alias("edition"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(strip_accents(split_part(text, chr(10), 1))), '&', ' and '), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS words FROM documents""")
def identity_words(spark, sf_dir):
    """Opening lines as plain ASCII words: letters lose their marks."""
    return table(spark, sf_dir, "documents").select("doc_id", text.identity_text(F.substring_index("text", "\n", 1)).alias("words"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN lpad(c_custkey::VARCHAR, 12, '7') WHEN 1 THEN lpad(c_custkey::VARCHAR, 12, '8') WHEN 2 THEN lpad(c_custkey::VARCHAR, 12, '9') WHEN 3 THEN lpad(c_custkey::VARCHAR, 8, '1') END AS code FROM customer""")
def product_codes(spark, sf_dir):
    """The first usable product number of several: separators go, and zeros before twelve digits."""
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    first = F.when(k % 5 == 0, F.concat(F.lit("0-"), F.lpad(s, 12, "7"))).when(k % 5 == 1, F.concat(F.lit("00"), F.lpad(s, 12, "8"))).when(k % 5 == 2, F.lpad(s, 12, "9")).when(k % 5 == 3, F.lit("12 34"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), text.gtin(first, F.when(k % 5 == 3, F.lpad(s, 8, "1"))).alias("code"))


@query(
    f"""WITH {_T}, w AS (SELECT id, list_distinct({_WORDS.format("title")}) AS w FROM t), p AS (SELECT a.id, b.id AS other, a.w AS x, b.w AS y FROM w a JOIN w b ON b.id = a.id + 1)
SELECT id, other, CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y))::DOUBLE / greatest(len(x), len(y)) ELSE 0 END::DOUBLE AS similarity, len(list_filter(x, lambda v: NOT list_contains(y, v))) = 0 AS whole FROM p"""
)
def title_similarity(spark, sf_dir):
    """Word similarity of each title with the next one, and whether all its words are there."""
    t = _titles(spark, sf_dir).select("id", text.word_list("title").alias("w"))
    p = t.join(t.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("w").alias("v")), "id")
    return p.select("id", "other", text.token_similarity(F.col("w"), F.col("v")).alias("similarity"), text.has_all_words(F.col("w"), F.col("v")).alias("whole"))


# ---- money and time ----------------------------------------------------------------------------------

_COUNTRIES = ["US", "uk ", "Canada", "AUSTRALIA", "jp", "EU", "Norway"]


@query(
    f"""WITH o AS (SELECT o_orderkey AS id, floor(o_totalprice)::BIGINT AS n, o_orderkey % 4 AS k, o_totalprice AS total FROM orders)
SELECT id, CASE k WHEN 0 THEN n + 0.5 WHEN 1 THEN n * 1000 + 250.25 WHEN 2 THEN 0 END::DOUBLE AS parsed, CASE k WHEN 0 THEN n + 0.5 WHEN 1 THEN n * 1000 + 250.25 WHEN 2 THEN -n END::DOUBLE AS first_amount,
  (n + CASE WHEN k = 0 THEN 4 ELSE 0 END)::DOUBLE AS total, CASE WHEN k < 3 THEN (n - 1000) / 9000.0::DOUBLE ELSE 0 END::DOUBLE AS scaled,
  CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.65 WHEN 2 THEN 0.3 ELSE least(1.0, n / 100000.0::DOUBLE) END::DOUBLE AS confidence,
  CASE id % 7 WHEN 0 THEN 'USD' WHEN 1 THEN 'GBP' WHEN 2 THEN 'CAD' WHEN 3 THEN 'AUD' WHEN 4 THEN 'JPY' WHEN 5 THEN 'EUR' END AS currency, CASE WHEN k = 1 THEN 'USD' WHEN k = 2 THEN NULL ELSE 'EUR' END AS code,
  CASE WHEN n <= 0 OR k = 3 THEN 'unknown' WHEN n / 10000.0::DOUBLE <= 15 THEN 'strong' WHEN n / 10000.0::DOUBLE <= 20 THEN 'fair' ELSE 'high' END AS tier,
  CASE WHEN id % 100 BETWEEN 35 AND 99 THEN id % 100 ELSE 35 END::INTEGER AS best_percent FROM o"""
)
def price_forms(spark, sf_dir):
    """Amounts, confidences, currencies, tiers and percentages read from texts."""
    n, k, i = F.floor("o_totalprice").cast("long"), F.col("o_orderkey") % 4, F.col("o_orderkey")
    shown = F.when(k == 0, F.concat(F.lit("US $"), n.cast("string"), F.lit(".50"))).when(k == 1, F.concat(F.lit("about "), n.cast("string"), F.lit(",250.25 each"))).when(k == 2, F.concat(F.lit("-"), n.cast("string"))).otherwise("free")
    sure = F.when(k == 0, "high").when(k == 1, "medium").when(k == 2, "low").otherwise((n / 100000.0).cast("string"))
    country = F.element_at(F.array(*[F.lit(c) for c in _COUNTRIES]), (i % 7 + 1).cast("int"))
    code = F.when(k == 1, " usd").when(k == 2, "US").otherwise("eur")
    words = F.concat(F.lit("save 20% or 35 %, "), (i % 100).cast("string"), F.lit("% or 120%"))
    return table(spark, sf_dir, "orders").select(
        i.alias("id"), money.parse_price(shown).alias("parsed"), money.first_amount(shown).alias("first_amount"), money.total_price(n.cast("double"), F.when(k == 0, 4.0)).alias("total"), money.scaled(F.when(k < 3, n), 1000, 10000).alias("scaled"),
        money.confidence(sure).alias("confidence"), money.currency_of_country(country).alias("currency"), money.currency_code(code).alias("code"), money.reconcile_price_tier(F.when(k != 3, n / 10000.0)).alias("tier"), money.max_percent(words).alias("best_percent"),
    )


@query(
    f"""SELECT o_orderkey AS id, CASE WHEN date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') >= 0 THEN date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') END::BIGINT AS age, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 0 END::BIGINT AS ahead,
  CASE WHEN date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') >= 0 THEN date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') END::BIGINT AS days, o_orderdate::DATE::VARCHAR AS read_back FROM orders"""
)
def age_forms(spark, sf_dir):
    """Ages in whole days, none for what lies ahead (but five minutes of clock skew), and dates written like Jul-10-01."""
    now = F.lit(f"{AS_OF} 00:00:00").cast("timestamp")
    ahead = F.when(F.col("o_orderkey") % 3 == 0, now + F.expr("interval 6 minutes")).otherwise(now + F.expr("interval 4 minutes"))
    written = F.date_format(F.when(F.year("o_orderdate") < 2000, F.add_months("o_orderdate", 1200)).otherwise(F.col("o_orderdate")), "MMM-d-yy")
    read = money.short_month_date(written)
    back = F.when(F.year("o_orderdate") < 2000, F.add_months(read, -1200)).otherwise(read)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), money.age_in_days("o_orderdate", now).alias("age"), money.age_in_days(ahead, now).alias("ahead"), money.date_age("o_orderdate", now).alias("days"), back.cast("string").alias("read_back"))


@query(
    f"""WITH {SOLD_SQL}, g AS (SELECT item, min(cents) FILTER (condition = 'used') AS a, min(cents) FILTER (cents > 0) AS b, min(cents) FILTER (condition = 'new_sealed') AS n, max(cents) FILTER (condition = 'unknown') AS x FROM sold GROUP BY item)
SELECT item, coalesce(a, b)::DOUBLE AS offer, least(n, x)::DOUBLE AS reference, CASE WHEN n IS NULL AND x IS NULL THEN NULL WHEN x IS NULL OR n <= x THEN 'sealed' ELSE 'unknown' END AS reference_source FROM g"""
)
def least_prices(spark, sf_dir):
    """The least available offer of every item, else the least of all; and the least of two reference prices with its name."""
    sold = sold_lines(spark, sf_dir)
    offer = F.struct(F.col("cents").cast("double").alias("price"), (F.col("condition") == "used").alias("available"))
    of = lambda c, f: f(F.when(F.col("condition") == c, F.col("cents")))
    g = sold.groupBy("item").agg(F.collect_set(offer).alias("offers"), of("new_sealed", F.min).alias("n"), of("unknown", F.max).alias("x"))
    ref = listings.least_reference(("sealed", F.col("n")), ("unknown", F.col("x")))
    return g.select("item", money.least_offer(F.col("offers")).alias("offer"), ref["value"].alias("reference"), ref["source"].alias("reference_source"))


@query(f"""WITH {SOLD_SQL} SELECT source, {round_sql("sum(cents * units)::DOUBLE / sum(units)::DOUBLE")} AS average, sum(units)::BIGINT AS kept, sum(greatest(1, gross))::BIGINT AS gross FROM sold GROUP BY source HAVING sum(units) > 0""")
def source_weights(spark, sf_dir):
    """Weighted average, units that stayed sold, and units in all, by source."""
    sold = sold_lines(spark, sf_dir)
    out = sold.groupBy("source").agg(aggregates.weighted_average("cents", "units").alias("a"), F.sum(aggregates.retained("gross", "units")).alias("kept"), F.sum(aggregates.retained("gross")).alias("gross"))
    return out.where("kept > 0").select("source", money.round_half_up("a").alias("average"), F.col("kept").cast("long").alias("kept"), F.col("gross").cast("long").alias("gross"))


# ---- offers, sellers, grades -------------------------------------------------------------------------

_OFFERS = ["BOGO on jazz", "Buy more save more today", "Use code SAVE20 now", "sale: up to 25% off", "Garage-sale finds", "warehouse overstock", "Final sale shelf", "Members only deal", "orders over $50 ship free", "Plain words"]


def _offers(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.element_at(F.array(*[F.lit(o) for o in _OFFERS]), (k % 10 + 1).cast("int")).alias("said"), F.when(k % 10 == 3, 25).alias("percent"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 10 WHEN 0 THEN 'bogo' WHEN 1 THEN 'volume' WHEN 2 THEN 'coupon' WHEN 3 THEN 'percent-sale' WHEN 4 THEN 'garage-sale' WHEN 5 THEN 'warehouse-overstock' WHEN 6 THEN 'clearance' ELSE 'sale' END AS kind,
  CASE WHEN s_suppkey % 10 = 3 THEN 'up_to' ELSE 'none' END AS qualifier, CASE WHEN s_suppkey % 10 = 2 THEN 'SAVE20' END AS code, s_suppkey % 10 IN (7, 8) AS conditional FROM supplier""")
def offer_kinds(spark, sf_dir):
    """Kind, qualifier, code and condition of sale texts."""
    o = _offers(spark, sf_dir).withColumn("code", text.promo_code("said"))
    return o.select("id", decisions.offer_type("said", "percent", "code").alias("kind"), decisions.discount_qualifier("said", "percent").alias("qualifier"), "code", listings.conditional_discount("said").alias("conditional"))


_STOCK = ["http://schema.org/InStock", "Sold out", "pre-order", "on backorder", "limited", "ask us", "OutOfStock"]


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 7 WHEN 0 THEN 'in_stock' WHEN 1 THEN 'out_of_stock' WHEN 2 THEN 'preorder' WHEN 3 THEN 'backorder' WHEN 4 THEN 'limited' WHEN 5 THEN 'unknown' ELSE 'out_of_stock' END AS state,
  s_suppkey % 3 = 1 AS expired, CASE WHEN s_suppkey % 60 + 30 <= 89 AND s_suppkey % 2 = 0 THEN s_suppkey % 60 + 30 END::INTEGER AS percent, s_suppkey % 4 = 0 AS same_shop FROM supplier""")
def page_states(spark, sf_dir):
    """State of stock texts, expired threads, the percentage that a sale path names, and whether two addresses are one shop's."""
    k = F.col("s_suppkey")
    stock = F.element_at(F.array(*[F.lit(s) for s in _STOCK]), (k % 7 + 1).cast("int"))
    url = F.when(k % 3 == 1, "https://d.example/t?q=thread%3Aexpired%3Atrue").otherwise("https://d.example/t")
    path = F.concat(F.lit("https://s.example/"), F.when(k % 2 == 0, "save-").otherwise("up-to-"), (k % 60 + 30).cast("string"), F.lit("-off"))
    shop = F.when(k % 4 == 0, "https://www.s.example/a").otherwise("https://other.example/a")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), text.availability(stock).alias("state"), urls.expired_deal(url).alias("expired"), urls.path_offer(path).alias("percent"), urls.same_host(shop, F.lit("https://S.example/b")).alias("same_shop"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false ELSE false END AS third_party, s_suppkey % 4 = 0 AS lead,
  CASE s_suppkey % 4 WHEN 0 THEN 'discovery_lead' WHEN 1 THEN 'official_api' WHEN 2 THEN CASE WHEN s_suppkey % 5 = 4 THEN 'direct_retailer' ELSE 'discovery_lead' END ELSE 'direct_retailer' END AS vouched,
  CASE s_suppkey % 4 WHEN 0 THEN 'group:discovery sources|crawl:deal aggregator' WHEN 1 THEN 'crawl:shop' WHEN 2 THEN 'retail:marketplace retailer|crawl:shop' ELSE 'crawl:shop' END AS family,
  s_suppkey % 4 = 3 AND s_suppkey % 5 IN (0, 3, 4) AND s_suppkey % 2 = 0 AS direct_us FROM supplier""")
def seller_rules(spark, sf_dir):
    """Third-party sellers, leads, how offers are vouched for, source families and direct new offers."""
    k = F.col("s_suppkey")
    flag = F.when(k % 5 == 1, False).when(k % 5 == 4, True)
    seller = F.when(k % 5 == 0, "Blue Moon Inc.").when(k % 5 == 2, "Someone Else").when(k % 5 == 3, "").otherwise("Someone Else")
    crawl, group = F.when(k % 4 == 0, "deal-aggregator").otherwise("shop"), F.when(k % 4 == 0, "Discovery Sources")
    retail = F.when(k % 4 == 2, "marketplace_retailer")
    third = listings.third_party_seller(flag, seller, F.lit("Blue Moon Online Store"))
    lead = listings.discovery_only(crawl, F.coalesce(group, F.lit("")))
    direct = listings.direct_new_offer(F.lit(" usa"), F.lit("usd"), F.when(k % 2 == 0, "Brand New").otherwise("used VG"), F.lit("https://www.shop.example/p/1"), F.lit("shop.example"), flag, lead | (k % 4 != 3), third)
    return table(spark, sf_dir, "supplier").select(
        k.alias("id"), third.alias("third_party"), lead.alias("lead"), listings.offer_verification(F.when(k % 4 == 1, "Official_API"), crawl, group, retail, flag).alias("vouched"), text.source_family(group, retail, crawl, F.lit(""), F.lit("x")).alias("family"), direct.alias("direct_us")
    )


_GRADED = ["Media: VG+ sleeve G", "LP NM/EX", "Near Mint copy", "plain LP", "sealed LP", "vinyl grade - Mint"]


@query("""SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'VG+' WHEN 1 THEN 'NM' WHEN 2 THEN 'NM' WHEN 3 THEN CASE WHEN p_type = 'PROMO' THEN 'Sealed' ELSE 'Unknown' END WHEN 4 THEN 'Sealed' ELSE 'M' END AS grade FROM part""")
def media_grades(spark, sf_dir):
    """Grades of media as listings write them, in short form."""
    title = F.element_at(F.array(*[F.lit(t) for t in _GRADED]), F.col("p_size") % 6 + 1)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), listings.media_grade(title, F.when(F.col("p_type") == "PROMO", "Brand New")).alias("grade"))


@query("""SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'Very Good (VG)' WHEN 1 THEN 'Near Mint (NM or M-)' END AS condition, CASE p_size % 3 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN p_size + 2.25 END::DOUBLE AS value FROM part""")
def guide_prices(spark, sf_dir):
    """The price of the first used grade that a guide knows, in its order."""
    n = F.col("p_size")
    grade = lambda name, value, when: F.when(when, F.create_map(F.lit(name), value))
    known = F.coalesce(grade("Very Good (VG)", n + 0.5, n % 3 == 0), F.when(n % 3 == 1, F.create_map(F.lit("Mint (M)"), F.lit(99.0), F.lit("Near Mint (NM or M-)"), n + 2.25)), F.create_map(F.lit("Fair (F)"), F.lit(0.0)))
    found = listings.guide_price(known)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), found["condition"].alias("condition"), found["value"].alias("value"))


@query("""SELECT c_custkey AS id, '["' || lower(c_name) || '","' || lower(c_mktsegment) || '",""]' AS seen, sha256('["' || lower(c_name) || '","' || lower(c_mktsegment) || '",""]') AS digest FROM customer""")
def observation_keys(spark, sf_dir):
    """Keys of observations and their content hashes."""
    key = listings.observation_key(F.concat(F.lit(" "), F.col("c_name")), F.col("c_mktsegment"), F.lit(None))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), key.alias("seen"), F.sha2(key, 256).alias("digest"))


@query(
    """SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '') || '/collections/all' || page_id || CASE WHEN page_id % 2 = 0 THEN '?color=red' ELSE '' END AS sale_page FROM pages"""
)
def sale_pages(spark, sf_dir):
    """Canonical addresses of sale pages: no tracking, no paging, a collection as a whole."""
    host = F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1)
    url = F.concat(host, F.lit("/Collections/ALL"), F.col("page_id").cast("string"), F.lit("/products/x/page/3?utm_source=a&ref=b"), F.when(F.col("page_id") % 2 == 0, "&color=red").otherwise(""), F.lit("#top"))
    return table(spark, sf_dir, "pages").select("page_id", urls.sale_page(url).alias("sale_page"))


# ---- small operators ---------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT c_custkey AS id, c_mktsegment || c_custkey % 400 AS title FROM customer), n AS (SELECT s_suppkey AS id, 'BUILDING' || s_suppkey % 450 AS title, s_acctbal AS price FROM supplier WHERE s_suppkey % 3 <> 0),
t AS (SELECT title, min(price) AS price FROM n GROUP BY title HAVING count(*) = 1) SELECT r.id, r.title, coalesce(n.price, t.price) AS price FROM r LEFT JOIN n ON n.id = r.id LEFT JOIN t ON t.title = r.title"""
)
def snapshot_values(spark, sf_dir):
    """Rows with the price of the current row of the same id, else of the only one of the same title."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.concat("c_mktsegment", (F.col("c_custkey") % 400).cast("string")).alias("title"))
    now = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").cast("long").alias("id"), F.concat(F.lit("BUILDING"), (F.col("s_suppkey") % 450).cast("string")).alias("title"), F.col("s_acctbal").alias("price"))
    return tables.snapshot_merge(rows, now, "id", "title", ["price"])


@query("""SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey = s_suppkey * 3 OR c_name = 'Customer#' || lpad(s_suppkey::VARCHAR, 9, '0')""")
def either_key_pairs(spark, sf_dir):
    """Pairs of customers and suppliers equal in one of two keys, as a union of equi-joins."""
    left = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("a"), F.col("c_name").alias("b"))
    k = F.col("s_suppkey")
    right = table(spark, sf_dir, "supplier").select("s_suppkey", (k * 3).cast("string").alias("c"), F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0")).alias("d"))
    return tables.either_key(left, right, [("a", "c"), ("b", "d")], "c_custkey", "s_suppkey")


@query("""SELECT o_orderkey AS entry, CASE WHEN o_custkey % 10 IN (3, 4) THEN o_custkey // 10 * 10 ELSE o_custkey END::BIGINT AS campaign FROM orders""")
def aliased_history(spark, sf_dir):
    """History entries under the campaign that theirs was merged into."""
    history = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), F.col("o_custkey").cast("long").alias("campaign"))
    k = F.col("c_custkey").cast("long")
    merged = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(k.alias("campaign"), F.array(k, k + 3, k + 4).alias("merged"))
    return tables.aliased(history, merged, "campaign", "merged").select("entry", "campaign")


@query("""WITH f AS (SELECT o_orderkey AS id, o_custkey AS offer, o_orderpriority AS seen FROM orders), c AS (SELECT o_custkey AS offer, max(o_orderpriority) AS seen FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)
SELECT id, offer, seen FROM f WHERE offer NOT IN (SELECT f.offer FROM f JOIN c ON c.offer = f.offer WHERE f.seen <> c.seen)""")
def pruned_feedback(spark, sf_dir):
    """Feedback without that on offers which have since been seen with other terms."""
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("offer"), F.col("o_orderpriority").alias("seen"))
    return tables.prune_stale(f, f.where("offer % 2 = 0").groupBy("offer").agg(F.max("seen").alias("seen")), "offer", "seen").select("id", "offer", "seen")


@query("""SELECT o_orderkey AS run FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 1""")
def latest_final_run(spark, sf_dir):
    """The most recent finished run."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "F", "Final").otherwise("draft").alias("phase"), F.col("o_orderdate").alias("created_at"))
    return tables.latest_final(runs).select("run")


@query("""SELECT o_custkey AS key, count(*) AS finds, bool_or(o_orderstatus = 'O') AS due, min(o_orderkey) AS first_id FROM orders GROUP BY 1""")
def search_queue(spark, sf_dir):
    """One entry for each search: how many finds wait, whether any is due, the first."""
    return tables.work_queue(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), "o_orderstatus"), "key", F.col("o_orderstatus") == "O")


@query("""WITH p AS (SELECT user_id AS source, event_type AS url, max(value) AS priority FROM events GROUP BY 1, 2), b AS (SELECT e.user_id AS source, e.event_type AS url, p.priority, max(e.ts) AS seen FROM events e JOIN p ON p.source = e.user_id AND p.url = e.event_type AND p.priority = e.value GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY priority DESC, seen DESC, url) AS rank FROM b) SELECT source, url, rank::INTEGER AS rank FROM r WHERE rank <= 2""")
def recheck_queue(spark, sf_dir):
    """The pages of every source that are looked at again first, each page once."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_type").alias("url"), "value", "ts")
    return tables.recheck_pages(e, "source", "url", F.col("value"), "ts", 2)


@query("""WITH g AS (SELECT event_id, user_id AS lane, event_id % 500 AS item, value AS price, CASE WHEN event_type = 'error' THEN 'bad' END AS reject FROM events),
b AS (SELECT item, price, event_id, row_number() OVER (PARTITION BY item ORDER BY price, event_id) AS r FROM g WHERE reject IS NULL), l AS (SELECT item, list_sort(list(DISTINCT lane)) AS lanes FROM g WHERE reject IS NULL GROUP BY item)
SELECT item, event_id, price, array_to_string(lanes, ',') AS lanes FROM b JOIN l USING (item) WHERE r = 1""")
def merged_lanes(spark, sf_dir):
    """Accepted rows once for each item, with the least price and all lanes that found it."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("lane"), (F.col("event_id") % 500).alias("item"), F.col("value").alias("price"), "event_type")
    kept, _ = tables.lanes(e, "lane", "item", "price", F.when(F.col("event_type") == "error", "bad"), [F.col("event_id")])
    return kept.select("item", "event_id", "price", F.array_join(F.transform("lanes", lambda x: x.cast("string")), ",").alias("lanes"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id // 10 ORDER BY length(event_type) * 10 + user_id % 10 DESC, event_id) AS n FROM events) SELECT event_id, user_id FROM r WHERE n = 1""")
def prioritised_events(spark, sf_dir):
    """Highest priority for each identity, both given by the caller."""
    e = table(spark, sf_dir, "events")
    return ranking.dedupe_by(e, F.floor(F.col("user_id") / 10), F.length("event_type") * 10 + F.col("user_id") % 10, [F.col("event_id")]).select("event_id", "user_id")


# ---- sources -----------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, floor(l_quantity)::BIGINT AS q, floor(l_extendedprice)::BIGINT AS paid, l_shipdate::DATE AS d FROM lineitem), h AS (SELECT DISTINCT o FROM l WHERE o % 2 = 0)
SELECT o::VARCHAR AS order_number, 'Item ' || p || '/' || s || '/' || n AS title, q AS quantity, (paid + 0.25)::DOUBLE AS sold_for, (CASE WHEN n % 2 = 0 THEN """ + round_sql("4.0::DOUBLE / q") + """ WHEN h.o IS NOT NULL THEN 1.5 ELSE 0 END)::DOUBLE AS shipping,
  """ + round_sql("paid + 0.25 + CASE WHEN n % 2 = 0 THEN " + round_sql("4.0::DOUBLE / q") + " WHEN h.o IS NOT NULL THEN 1.5 ELSE 0 END") + """ AS total_paid FROM l LEFT JOIN h USING (o)""")
def order_export_lines(spark, sf_dir):
    """Sold lines of an order export: prices read from texts, shipping the line's own, else its order header's, by unit."""
    n, q = F.col("l_linenumber"), F.floor("l_quantity").cast("long")
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("Order Number"), F.concat(F.lit("Item "), F.concat_ws("/", "l_partkey", "l_suppkey", "l_linenumber")).alias("Item Title"), F.lit("Whole").alias("Custom Label"), q.cast("string").alias("Quantity"),
        F.concat(F.lit("$"), F.format_number(F.floor("l_extendedprice").cast("long"), 0), F.lit(".25")).alias("Sold For"), F.when(n % 2 == 0, "$4.00").alias("Shipping And Handling"), F.date_format("l_shipdate", "MMM-d-yy").alias("Sale Date"),
    )
    head = table(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 0").select(F.col("l_orderkey").cast("string").alias("Order Number")).distinct()
    blank = F.lit(None).cast("string")
    head = head.select("Order Number", blank.alias("Item Title"), blank.alias("Custom Label"), F.lit("2").alias("Quantity"), blank.alias("Sold For"), F.lit("$3.00").alias("Shipping And Handling"), blank.alias("Sale Date"))
    return files.order_lines(line.unionByName(head)).select("order_number", "title", "quantity", "sold_for", "shipping", "total_paid")


@query("""SELECT p_brand AS shop, 'h' || p_partkey AS handle, p_name || CASE WHEN p_size % 2 = 0 THEN ' - red' ELSE '' END AS title, 'https://s.example/products/h' || p_partkey || '?variant=' || p_partkey AS url, (p_size + 0.5)::DOUBLE AS price,
  CASE WHEN p_size % 3 = 0 THEN p_size + 5.5 END::DOUBLE AS compare_at, CASE WHEN p_size % 5 = 0 THEN '00' || p_partkey END AS barcode FROM part WHERE p_size % 7 <> 0""")
def shop_variants(spark, sf_dir):
    """Available, priced variants of shop catalogues, from their JSON pages."""
    n, k = F.col("p_size"), F.col("p_partkey").cast("string")
    variant = F.struct(
        k.alias("id"), F.when(n % 2 == 0, "red").otherwise("Default Title").alias("title"), F.concat(n.cast("string"), F.lit(".50")).alias("price"), F.concat((n + F.when(n % 3 == 0, 5).otherwise(-1)).cast("string"), F.lit(".50")).alias("compare_at_price"),
        (n % 7 != 0).alias("available"), F.when(n % 5 == 0, F.concat(F.lit(" 00"), k)).otherwise(" ").alias("barcode"),
    )
    product = F.struct(F.col("p_name").alias("title"), F.concat(F.lit("h"), k).alias("handle"), F.array(variant).alias("variants"))
    pages = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("shop"), F.floor(F.col("p_partkey") / 20).alias("_page")).agg(F.to_json(F.struct(F.collect_list(product).alias("products"))).alias("body"))
    rows = catalogs.variant_rows(pages.withColumn("origin", F.lit("https://s.example")), "shop", "body", "origin")
    return rows.select("shop", "handle", "title", "url", "price", "compare_at", "barcode")


@query("""SELECT p_partkey AS page, p_name AS title, 'S' || p_partkey AS sku, CASE WHEN p_size % 4 = 1 THEN '0' || p_partkey END AS gtin, CASE WHEN p_size % 4 = 3 THEN NULL ELSE p_size + 0.25 END::DOUBLE AS price FROM part WHERE p_size % 4 <> 2""")
def json_ld_parts(spark, sf_dir):
    """Products in ld+json scripts: alone, in a graph, in a list, with offers out of stock left out."""
    n, k = F.col("p_size"), F.col("p_partkey").cast("string")
    offer = F.concat(F.lit('{"@type":"Offer","price":"'), n.cast("string"), F.lit('.25","availability":"'), F.when(n % 4 == 2, "http://schema.org/OutOfStock").otherwise("http://schema.org/InStock"), F.lit('"}'))
    product = F.concat(F.lit('{"@type":"Product","name":"'), F.col("p_name"), F.lit('","sku":"S'), k, F.lit('"'), F.when(n % 4 == 1, F.concat(F.lit(',"gtin13":"0'), k, F.lit('"'))).otherwise(""), F.when(n % 4 == 3, "").when(n % 2 == 0, F.concat(F.lit(',"offers":'), offer)).otherwise(F.concat(F.lit(',"offers":['), offer, F.lit("]"))), F.lit("}"))
    body = F.when(n % 3 == 0, product).when(n % 3 == 1, F.concat(F.lit('{"@graph":['), product, F.lit("]}"))).otherwise(F.concat(F.lit('{"@type":"ItemList","itemListElement":[{"item":'), product, F.lit("}]}")))
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.concat(F.lit('<html><script type="application/ld+json">'), body, F.lit('</script><script type="application/ld+json">{broken</script></html>')).alias("html"))
    return html.json_ld_products(pages, "page").select("page", "title", "sku", "gtin", "price")


@query("""SELECT p_partkey AS page, [p_size + 0.97, p_size + 10.99]::DOUBLE[] AS all_prices, (p_size + 0.97)::DOUBLE AS current, (p_size + 10.99)::DOUBLE AS original, floor((p_size + 10.99 - (p_size + 0.97))::DOUBLE / (p_size + 10.99)::DOUBLE * 100 + 0.5)::BIGINT AS discount FROM part""")
def retail_prices(spark, sf_dir):
    """Prices of product texts: was-prices beside now-prices, none of unit prices, shipping or savings; and a deal page read whole."""
    n = F.col("p_size").cast("string")
    shown = F.concat(F.lit("$"), n, F.lit(".97 Was $"), (F.col("p_size") + 10).cast("string"), F.lit(".99 $34.43/ea shipping $4.99 save $2.00 $5.99 delivery"))
    page = F.concat(F.lit("<h1>Deal</h1><div>"), shown, F.lit("</div>Price history $1.00"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), page.alias("html"), shown.alias("shown"))
    deal = catalogs.deal_detail(p, "page", "html")
    return deal.join(p.select("page", html.prices("shown").alias("all_prices")), "page").select("page", "all_prices", "current", "original", "discount")


@query("""SELECT p_partkey AS page, p_name || ' $' || p_size || '.25' AS title, (p_size + 0.25)::DOUBLE AS price, 'https://f.example/' || p_partkey AS discussion_url, 'https://shop.example/' || p_partkey AS deal_url, p_size % 5 = 0 AS expired FROM part""")
def deal_feed(spark, sf_dir):
    """Entries of an Atom feed: price in the title, the link out of the forum, expired threads."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_size")
    entry = F.concat(F.lit("<feed><entry><title>"), F.col("p_name"), F.lit(" $"), n.cast("string"), F.lit('.25</title><link href="https://f.example/'), k, F.lit('"/><content>&lt;a href="https://f.example/u"&gt;u&lt;/a&gt; &lt;a href="https://shop.example/'), k, F.lit('"&gt;x&lt;/a&gt;'), F.when(n % 5 == 0, " Expired").otherwise(""), F.lit("</content></entry><entry><title></title></entry></feed>"))
    return catalogs.feed_entries(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), entry.alias("xml")), "page", "xml").select("page", "title", "price", "discussion_url", "deal_url", "expired")


@query("""SELECT p_partkey AS id, CASE p_size % 3 WHEN 2 THEN 'Unknown Artist' ELSE p_brand END AS artist, CASE p_size % 3 WHEN 2 THEN p_name ELSE p_type END AS title, 'Jan 5, 2001' AS last_sold, (p_size + 0.5)::DOUBLE AS low, (p_size + 1)::DOUBLE AS median, CASE WHEN p_size % 2 = 0 THEN p_size + 9.25 END::DOUBLE AS high FROM part""")
def headlines(spark, sf_dir):
    """Artist and title of deal headlines, and the numbers of a statistics text."""
    n = F.col("p_size")
    head = F.when(n % 3 == 0, F.concat(F.lit("[Deal] (US) "), F.col("p_brand"), F.lit(" - "), F.col("p_type"), F.lit(" $19.99 shipped"))).when(n % 3 == 1, F.concat(F.col("p_brand"), F.lit(' "'), F.col("p_type"), F.lit('" LP'))).otherwise(F.concat(F.col("p_name"), F.lit(" @ $5")))
    stats = F.concat(F.lit("Last Sold: Jan 5, 2001<br>Low: $"), n.cast("string"), F.lit(".5 Median: "), (n + 1).cast("string"), F.when(n % 2 == 0, F.concat(F.lit(" High: $"), (n + 9).cast("string"), F.lit(".25"))).otherwise(" High: --"))
    both, numbers = catalogs.artist_title(head), catalogs.sales_stats(stats)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), both["artist"].alias("artist"), both["title"].alias("title"), *[c.alias(k) for k, c in numbers.items()])




# ---- page payloads -----------------------------------------------------------------------------------

_MONEY = "({0} // 100)::VARCHAR || '.' || lpad(({0} % 100)::VARCHAR, 2, '0')"
_PAYLOAD_SQL = f"""p AS (SELECT p_partkey AS k, p_partkey // 50 AS page, p_name AS name, p_size AS size, floor(p_retailprice * 100 + 0.5)::BIGINT AS c FROM part),
card AS (SELECT page, k, repeat('{{"group":[', length(name) % 4) || '{{"productId":"P' || k || '","productTitle":"' || name || ' Vinyl","currentPrice":{{"displayValue":"$' || {_MONEY.format("c")} || '"}},"regular_price":"$' || {_MONEY.format("(c + 500 + size * 10)")}
  || '","availability":"' || CASE WHEN size < 10 THEN 'Only 2 left' WHEN size < 20 THEN 'Sold out' ELSE 'In stock' END || '","product_url":"/p/' || k || '?utm_source=mail&v=' || size || '"}}' || repeat(']}}', length(name) % 4) AS j FROM p),
again AS (SELECT page, k, '{{"name":"' || name || ' {{LP}}","productId":"P' || k || '","price":' || {_MONEY.format("(c + size - 30)")} || ',"sku":"S' || k || '","available":' || CASE WHEN size > 40 THEN 'true' ELSE 'false' END || '}}' AS j FROM p WHERE size > 25),
text AS (SELECT page, 'application_json' AS kind, '{{"navigation":{{"items":[{{"productId":"N' || page || '","title":"Not a product","price":3}}]}},"shelves":[' || string_agg(j, ',' ORDER BY k) || ']}}' AS body FROM card GROUP BY page
  UNION ALL SELECT page, 'next_data', '{{"props":[' || string_agg(j, ',' ORDER BY k) || ']}}' FROM again GROUP BY page)"""


def _payload_pages(spark, sf_dir):
    """Shop pages of fifty parts: a JSON script with cards in groups of groups, and an assigned payload that has some of them again."""
    c = F.col("c")
    amount = lambda x: F.concat(F.floor(x / 100).cast("long").cast("string"), F.lit("."), F.lpad((x % 100).cast("string"), 2, "0"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 50).cast("long").alias("page"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size"), F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long").alias("c"))
    deep = F.length("name") % 4
    state = F.when(F.col("size") < 10, "Only 2 left").when(F.col("size") < 20, "Sold out").otherwise("In stock")
    card = F.concat(F.repeat(F.lit('{"group":['), deep), F.lit('{"productId":"P'), "k", F.lit('","productTitle":"'), "name", F.lit(' Vinyl","currentPrice":{"displayValue":"$'), amount(c), F.lit('"},"regular_price":"$'), amount(c + 500 + F.col("size") * 10), F.lit('","availability":"'), state, F.lit('","product_url":"/p/'), "k", F.lit("?utm_source=mail&v="), "size", F.lit('"}'), F.repeat(F.lit("]}"), deep))
    again = F.when(F.col("size") > 25, F.concat(F.lit('{"name":"'), "name", F.lit(' {LP}","productId":"P'), "k", F.lit('","price":'), amount(c + F.col("size") - 30), F.lit(',"sku":"S'), "k", F.lit('","available":'), F.when(F.col("size") > 40, "true").otherwise("false"), F.lit("}")))
    joined = lambda field: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("k", field))), lambda x: x[field].isNotNull()), lambda x: x[field]), ",")
    pages = p.withColumn("card", card).withColumn("again", again).groupBy("page").agg(joined("card").alias("cards"), joined("again").alias("more"))
    script = F.concat(F.lit('<script type="application/json">{"navigation":{"items":[{"productId":"N'), "page", F.lit('","title":"Not a product","price":3}]},"shelves":['), "cards", F.lit("]}</script>"))
    assigned = F.when(F.col("more") != "", F.concat(F.lit('<script>window.__NEXT_DATA__ = {"props":['), "more", F.lit("]}; go('}');</script>"))).otherwise("")
    return pages.select("page", F.concat(F.lit("https://shop.example/c/"), "page").alias("url"), F.concat(F.lit("<html>"), script, F.lit("<p>text</p>"), assigned, F.lit("</html>")).alias("html"))


@query(
    f"""WITH RECURSIVE {_PAYLOAD_SQL},
walk AS (SELECT page, kind, 0 AS depth, body::JSON AS v FROM text
  UNION ALL SELECT page, kind, depth + 1, unnest(CASE WHEN depth = 0 THEN list_filter([json_extract(v, '$.shelves'), json_extract(v, '$.props')], lambda x: x IS NOT NULL) WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE json_extract(v, '$.*') END) FROM walk WHERE json_type(v) IN ('ARRAY', 'OBJECT')),
node AS (SELECT page, kind, json_extract_string(v, '$.productId') AS id, coalesce(json_extract_string(v, '$.productTitle'), json_extract_string(v, '$.name')) AS title, json_extract_string(v, '$.sku') AS sku,
  'https://shop.example' || regexp_replace(json_extract_string(v, '$.product_url'), 'utm_source=mail&', '') AS url, coalesce(ltrim(json_extract_string(v, '$.currentPrice.displayValue'), '$'), json_extract_string(v, '$.price'))::DOUBLE AS price,
  ltrim(json_extract_string(v, '$.regular_price'), '$')::DOUBLE AS regular, coalesce(json_extract_string(v, '$.availability'), json_extract_string(v, '$.available')) AS s FROM walk WHERE json_type(v) = 'OBJECT' AND json_extract_string(v, '$.productId') IS NOT NULL),
named AS (SELECT *, CASE s WHEN 'Sold out' THEN 1 WHEN 'false' THEN 1 WHEN 'Only 2 left' THEN 4 ELSE 5 END AS r FROM node)
SELECT page, 'product:' || lower(id) AS stable_id, arg_max(title, length(title)) AS title, max(url) AS url, max(sku) AS sku, min(price) AS price, CASE WHEN max(regular) > min(price) THEN max(regular) END AS regular,
  CASE max(r) WHEN 1 THEN 'out_of_stock' WHEN 4 THEN 'limited_stock' ELSE 'in_stock' END AS state, max(r) > 1 AS available, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS evidence FROM named GROUP BY page, id"""
)
def payload_products(spark, sf_dir):
    """Products of shop pages from their JSON payloads, at any depth, those a page shows twice as one."""
    found = payloads.catalogue(_payload_pages(spark, sf_dir), "page")
    return found.select("page", "stable_id", "title", "url", "sku", "price", "regular", "state", "available", "kinds", "evidence")


@query(
    f"""WITH RECURSIVE {_PAYLOAD_SQL},
walk AS (SELECT page, kind, 0 AS depth, body::JSON AS v FROM text
  UNION ALL SELECT page, kind, depth + 1, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE json_extract(v, '$.*') END) FROM walk WHERE json_type(v) IN ('ARRAY', 'OBJECT'))
SELECT page, kind, depth, count(*) AS n, coalesce(sum(length(json_extract_string(v, '$'))) FILTER (json_type(v) = 'VARCHAR'), 0)::BIGINT AS letters FROM walk WHERE json_type(v) NOT IN ('ARRAY', 'OBJECT') GROUP BY page, kind, depth"""
)
def payload_leaves(spark, sf_dir):
    """Scalars of page payloads by depth: how many, and how long the strings among them are."""
    found = payloads.leaves(payloads.payloads(_payload_pages(spark, sf_dir), "page"), "page")
    return found.groupBy("page", "kind", F.size("path").alias("depth")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(~F.element_at("path", -1).isin("price", "available"), F.length("value"))), F.lit(0)).alias("letters"))

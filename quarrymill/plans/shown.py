"""Queries of orders, filters, summaries and identities over the supplied tables, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identities
from ..operators import orderings
from .adapters import table
from .catalogue import query

# ---- orders ------------------------------------------------------------------------------------------


def _place(order, *keys):
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("place")


_DECISIONS = "[{}][p_size % 4 + 1]".format("'BUY', 'WATCH', 'REVIEW', 'REJECT'")


def _shown(spark, sf_dir):
    n, k = F.col("p_size"), F.col("p_partkey")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i + 1)
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_brand").alias("brand"), F.concat_ws(" ", "p_name", k.cast("string")).alias("title"), F.col("p_type").alias("source_name"), pick(["BUY", "WATCH", "REVIEW", "REJECT"], n % 4).alias("decision"), pick(["A", "B", "C", "REJECT"], n % 3).alias("band"),
        (n * 2).cast("long").alias("score"), (n % 7).cast("double").alias("net_profit"), F.col("p_retailprice").alias("price"), F.when(n % 5 != 0, n / 4.0).alias("profit_per_30"), F.when(n % 3 != 0, n * 1.0).alias("days_to_sell"), F.when(n % 2 == 0, n / 8.0).alias("long_supply_months"),
        F.when(n % 3 == 0, n / 16.0).alias("supply_months"), (n % 11).cast("double").alias("quality"), F.when(n % 6 == 0, False).otherwise(True).alias("available"), F.when(n % 9 == 0, "Sold out today").alias("stock"), F.when(n % 4 == 1, False).alias("sold_by_source"),
    )


_SHOWN_SQL = f"""s AS (SELECT p_partkey AS id, p_brand AS brand, p_name || ' ' || p_partkey AS title, p_type AS source_name, {_DECISIONS} AS decision, ['A', 'B', 'C'][p_size % 3 + 1] AS band, p_size AS n, p_retailprice AS price FROM part)"""


@query(f"""WITH {_SHOWN_SQL} SELECT id,
  row_number() OVER (PARTITION BY brand ORDER BY n % 11 DESC, source_name, title) AS as_candidate,
  row_number() OVER (PARTITION BY brand ORDER BY CASE WHEN n % 6 = 0 OR n % 9 = 0 THEN 1 ELSE 0 END, CASE WHEN n % 4 = 1 THEN 1 ELSE 0 END, price, n % 11 DESC, source_name, title) AS as_offer,
  row_number() OVER (PARTITION BY brand ORDER BY CASE decision WHEN 'BUY' THEN 4 WHEN 'WATCH' THEN 3 WHEN 'REVIEW' THEN 2 ELSE 1 END DESC, n * 2 DESC, nullif(n % 7, 0) DESC NULLS LAST, n % 11 DESC, id) AS as_evaluated,
  row_number() OVER (PARTITION BY brand ORDER BY CASE decision WHEN 'BUY' THEN 4 WHEN 'WATCH' THEN 3 WHEN 'REVIEW' THEN 2 ELSE 1 END DESC, band, n * 2 DESC, title) AS by_priority,
  row_number() OVER (PARTITION BY brand ORDER BY CASE WHEN n % 3 <> 0 THEN n END NULLS LAST, title) AS by_turn,
  row_number() OVER (PARTITION BY brand ORDER BY CASE WHEN n % 5 <> 0 THEN n END DESC NULLS LAST, title) AS by_profit_rate,
  row_number() OVER (PARTITION BY brand ORDER BY CASE WHEN n % 2 = 0 THEN n / 8.0 WHEN n % 3 = 0 THEN n / 16.0 END NULLS LAST, title) AS by_supply, row_number() OVER (PARTITION BY brand ORDER BY source_name, title) AS by_source FROM s""")
def find_orders(spark, sf_dir):
    """Places of finds within their brand, in each of the orders that rank or show them."""
    s = _shown(spark, sf_dir)
    orders = {"as_candidate": orderings.ranked_candidates(), "as_offer": orderings.duplicate_offers(), "as_evaluated": [*orderings.evaluated(), F.col("id")]}
    orders |= {f"by_{k}": orderings.finds(v) for k, v in {"priority": "priority", "turn": "turn", "profit_rate": "profit_rate", "supply": "long_term_supply", "source": "source"}.items()}
    return s.select("id", *[_place(o, "brand").alias(n) for n, o in orders.items()])


@query("""WITH c AS (SELECT o_orderkey AS id, o_custkey AS shop, ['new', 'changed', 'ongoing', 'unknown', 'evergreen', 'ended', 'other'][o_orderkey % 7 + 1] AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS seen, o_orderdate + INTERVAL 3 DAY AS captured, [6, 5, 4, 3, 2, 1, 0][o_orderkey % 7 + 1] AS r FROM orders)
SELECT id, row_number() OVER (PARTITION BY shop ORDER BY r DESC, coalesce(seen, TIMESTAMP '1970-01-01') DESC, id) AS place, row_number() OVER (PARTITION BY shop ORDER BY r DESC, coalesce(seen, captured) DESC, id) AS shelf FROM c""")
def campaign_orders(spark, sf_dir):
    """Places of campaigns within their shop, as they are kept and as they are shown."""
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(s) for s in ("new", "changed", "ongoing", "unknown", "evergreen", "ended", "other")]), (k % 7 + 1).cast("int"))
    day = F.col("o_orderdate").cast("timestamp")
    c = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("shop"), status.alias("status"), F.when(k % 5 != 0, day).alias("last_seen"), (day + F.expr("interval 3 days")).alias("captured_at"))
    return c.select("id", _place(orderings.campaigns(), "shop"), _place([*orderings.shelf(), F.col("id")], "shop").alias("shelf"))


@query("""WITH b AS (SELECT l_suppkey AS batch, l_orderkey AS o, l_linenumber AS n, l_partkey AS p, 'T' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS title, l_shipdate::DATE::VARCHAR AS day, CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice END AS profit,
  CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS category FROM lineitem)
SELECT o, n, p, row_number() OVER (PARTITION BY batch ORDER BY day, title) AS as_record, row_number() OVER (PARTITION BY batch ORDER BY profit DESC NULLS LAST, title) AS by_profit, row_number() OVER (PARTITION BY batch ORDER BY category, title) AS by_category,
  row_number() OVER (PARTITION BY batch ORDER BY profit NULLS LAST, title) AS by_buy, row_number() OVER (PARTITION BY batch ORDER BY n, title) AS by_order FROM b""")
def ledger_orders(spark, sf_dir):
    """Places of lines within their batch: as records, and in orders of the bulk ledger."""
    n, profit = F.col("l_linenumber"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice"))
    category = F.when(n % 4 == 0, "under_5").when(n % 4 == 1, "5_to_25").when(n % 4 == 2, "over_25")
    title = F.concat(F.lit("T"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), n.alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("batch"), title.alias("title"), title.alias("record_key"), F.to_date("l_shipdate").alias("sale_date"), profit.alias("profit"), profit.alias("buy_price"), profit.alias("sale_price"), profit.alias("median"), category.alias("category"), F.lit("used").alias("condition"), n.alias("order"))
    orders = {"as_record": orderings.records(), "by_profit": orderings.ledger("profit", True), "by_category": orderings.ledger("category"), "by_buy": orderings.ledger("buy"), "by_order": orderings.ledger("order")}
    return b.select("o", "n", "p", *[_place(o, "batch").alias(k) for k, o in orders.items()])


@query("""WITH c AS (SELECT s_suppkey AS id, 'd' || s_nationkey AS domain, s_suppkey % 4 + 1 AS priority, s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY priority, name) AS n FROM c) SELECT id, domain FROM r WHERE n = 1""")
def active_sources(spark, sf_dir):
    """One source for each domain, the first by priority; discovery-only ones left out."""
    k = F.col("s_suppkey")
    c = table(spark, sf_dir, "supplier").select(k.alias("id"), F.concat(F.lit("d"), F.col("s_nationkey").cast("string")).alias("domain"), (k % 4 + 1).alias("priority"), F.col("s_name").alias("name"), (k % 3 == 0).alias("discovery_only"))
    return orderings.active_domains(c).select("id", "domain")


# ---- what is shown -----------------------------------------------------------------------------------


def _reviewed(spark, sf_dir):
    n = F.col("p_size")
    outcome = F.when(n % 5 == 0, "bad_match").when(n % 5 == 1, "bought")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("source"), F.element_at(F.array(*[F.lit(d) for d in ("BUY", "WATCH", "REVIEW", "REJECT")]), n % 4 + 1).alias("decision"), outcome.alias("outcome"), F.when(n % 7 == 0, F.lit("2024-01-01").cast("timestamp")).alias("dismissed_at"),
        (n % 2 == 0).alias("sold_evidence"), (n % 3 == 0).alias("active_evidence"),
    )


_REVIEWED_SQL = f"v AS (SELECT p_partkey AS id, p_type AS source, {_DECISIONS} AS decision, p_size % 5 AS o, p_size % 7 = 0 AS dismissed, p_size AS n FROM part)"


@query(f"""WITH {_REVIEWED_SQL} SELECT 'review' AS view, id FROM v WHERE NOT dismissed AND o NOT IN (0, 1) AND decision = 'REVIEW' UNION ALL SELECT 'hidden', id FROM v WHERE dismissed OR o = 0 UNION ALL SELECT 'tracked', id FROM v WHERE o = 1
UNION ALL SELECT 'promo', id FROM v WHERE NOT dismissed AND o NOT IN (0, 1) AND source = 'PROMO'""")
def visible_finds(spark, sf_dir):
    """Finds of four views: to be reviewed, hidden, tracked, and one retailer's."""
    v = _reviewed(spark, sf_dir)
    views = {"review": orderings.visible_finds(v, "NEEDS_VALIDATION"), "hidden": orderings.visible_finds(v, "DISMISSED"), "tracked": orderings.visible_finds(v, "TRACKED"), "promo": orderings.visible_finds(v, source="PROMO")}
    parts = [f.select(F.lit(name).alias("view"), "id") for name, f in views.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {_REVIEWED_SQL} SELECT count(*) FILTER (NOT dismissed AND o NOT IN (0, 1) AND decision = 'BUY') AS buy, count(*) FILTER (NOT dismissed AND o NOT IN (0, 1) AND decision = 'WATCH') AS watch, count(*) FILTER (NOT dismissed AND o NOT IN (0, 1) AND decision = 'REVIEW') AS review,
  count(*) FILTER (NOT dismissed AND o NOT IN (0, 1) AND decision = 'REJECT') AS reject, count(*) FILTER (n % 2 = 0) AS sold_validated, count(*) FILTER (n % 3 = 0) AS active_validated, count(*) AS total FROM v""")
def finds_summary(spark, sf_dir):
    """Finds by decision, without dismissed and judged ones, and those with evidence."""
    return orderings.finds_summary(_reviewed(spark, sf_dir))


@query(f"""WITH {_REVIEWED_SQL}, p AS (SELECT source, count(*) AS n FROM v GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS finds, count(*) AS sources, round(max(n) / sum(n)::DOUBLE, 4) AS largest_share, round(sum(n * n) / (sum(n) * sum(n))::DOUBLE, 4) AS concentration FROM p)
SELECT finds, sources, (SELECT count(*) FROM v WHERE decision = 'BUY') AS buy, (SELECT count(*) FROM v WHERE decision = 'WATCH') AS watch, (SELECT count(*) FROM v WHERE decision = 'REVIEW') AS review, (SELECT count(*) FROM v WHERE decision = 'REJECT') AS reject, largest_share, concentration FROM t""")
def scan_summary(spark, sf_dir):
    """A scan by decision, with the concentration of its sources."""
    return orderings.scan_summary(_reviewed(spark, sf_dir))


@query("""WITH c AS (SELECT ['new', 'changed', 'ongoing', 'unknown', 'evergreen', 'ended', 'other'][o_orderkey % 7 + 1] AS s FROM orders) SELECT count(*) AS total, count(*) FILTER (s IN ('new', 'changed', 'ongoing', 'evergreen')) AS active, count(*) FILTER (s = 'new') AS "new", count(*) FILTER (s = 'changed') AS changed,
  count(*) FILTER (s = 'ongoing') AS ongoing, count(*) FILTER (s = 'unknown') AS unknown, count(*) FILTER (s = 'evergreen') AS evergreen, count(*) FILTER (s = 'ended') AS ended FROM c""")
def campaign_summary(spark, sf_dir):
    """Campaigns by state."""
    k = F.col("o_orderkey")
    return orderings.campaign_summary(table(spark, sf_dir, "orders").select(F.element_at(F.array(*[F.lit(s) for s in ("new", "changed", "ongoing", "unknown", "evergreen", "ended", "other")]), (k % 7 + 1).cast("int")).alias("status")))


@query("""WITH e AS (SELECT event_id AS seq, user_id AS campaign, user_id % 3 AS source, event_type AS to_status FROM events), c AS (SELECT DISTINCT user_id AS campaign FROM events WHERE user_id % 3 = 1 AND user_id % 2 = 0)
SELECT seq, campaign, to_status FROM e WHERE source = 1 AND to_status = 'click' AND campaign IN (SELECT campaign FROM c) ORDER BY seq DESC LIMIT 50""")
def campaign_history(spark, sf_dir):
    """The latest fifty events of one source's campaigns into one state."""
    u = F.col("user_id")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), u.alias("campaign"), (u % 3).alias("source"), F.col("event_type").alias("to_status"))
    c = e.where("campaign % 2 = 0").select("campaign", "source").distinct()
    return orderings.campaign_history(c, e, 50, 1, "click").select("seq", "campaign", "to_status")


def _reports(spark, sf_dir):
    k = F.col("s_suppkey")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        k.alias("id"), pick(["ok", "partial", "error", "ok", "ok"], k % 5).alias("status"), pick(["healthy", "failed", "not_checked"], k % 3).alias("catalog"), pick(["failed", "healthy", "not_attempted", "partial"], k % 4).alias("sale"), pick(["selected", "parser_empty", "high_signal"], F.floor(k / 5) % 3).alias("usable"),
        (k % 6).alias("candidates"), (k % 4).alias("attempted"), (k % 2).alias("available"), (k % 3).alias("sale_pages"), (k % 2).alias("priority"), pick(["deal-aggregator", "shop", "Social-Feed "], k % 3).alias("crawl"), F.when(k % 5 == 0, "Discovery Sources").alias("group"),
    )


_REPORTS_SQL = """r AS (SELECT s_suppkey AS k, ['ok', 'partial', 'error', 'ok', 'ok'][s_suppkey % 5 + 1] AS status, ['healthy', 'failed', 'not_checked'][s_suppkey % 3 + 1] AS catalog, ['failed', 'healthy', 'not_attempted', 'partial'][s_suppkey % 4 + 1] AS sale, ['selected', 'parser_empty', 'high_signal'][s_suppkey // 5 % 3 + 1] AS usable,
  CASE WHEN s_suppkey % 6 > 0 THEN 'productive' WHEN s_suppkey % 4 = 0 THEN 'not_attempted' WHEN s_suppkey % 2 > 0 THEN 'empty' ELSE 'failed' END AS product FROM supplier),
b AS (SELECT *, CASE WHEN status = 'error' OR product = 'failed' THEN 'blocked' WHEN status = 'partial' OR sale = 'partial' OR product = 'empty' OR usable = 'parser_empty' THEN 'degraded'
  WHEN (catalog = 'failed' AND sale IN ('failed', 'not_attempted')) OR (catalog = 'not_checked' AND sale = 'failed') THEN 'blocked' WHEN catalog = 'failed' OR sale = 'failed' THEN 'degraded' ELSE 'healthy' END AS bucket FROM r)"""


@query(f"WITH {_REPORTS_SQL} SELECT k AS id, product, bucket, k % 3 = 1 AND k % 5 <> 0 AS direct FROM b")
def source_buckets(spark, sf_dir):
    """Parse health, coverage bucket and directness of source reports."""
    r = _reports(spark, sf_dir).withColumn("product", orderings.parse_health("candidates", "attempted", "available"))
    return r.select("id", "product", orderings.coverage_bucket("status", "product", "usable", "catalog", "sale").alias("bucket"), orderings.direct_report("crawl", "group", F.lit(None).cast("string")).alias("direct"))


@query(f"""WITH {_REPORTS_SQL} SELECT count(*) AS attempted, count(*) FILTER (bucket = 'healthy') AS healthy, count(*) FILTER (bucket = 'degraded') AS degraded, count(*) FILTER (bucket = 'blocked') AS blocked, count(*) FILTER (product <> 'not_attempted') AS product_attempted,
  count(*) FILTER (product <> 'not_attempted' AND usable IN ('selected', 'high_signal')) AS product_usable, count(*) FILTER (product = 'empty') AS parser_empty, count(*) FILTER (product = 'failed') AS product_failed, count(*) FILTER (k % 3 > 0 OR sale IN ('healthy', 'partial')) AS sale_capable,
  count(*) FILTER (k % 2 = 1) AS priority_total, count(*) FILTER (k % 2 = 1 AND bucket = 'healthy') AS priority_healthy FROM b""")
def coverage_summary(spark, sf_dir):
    """Coverage of a scan's sources in one row."""
    r = _reports(spark, sf_dir).withColumn("product", orderings.parse_health("candidates", "attempted", "available"))
    return orderings.coverage_summary(r.withColumn("bucket", orderings.coverage_bucket("status", "product", "usable", "catalog", "sale")))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 <> 0 THEN o_orderdate ELSE o_orderdate - INTERVAL 9 DAY END::DATE::VARCHAR AS cursor_from, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 5 DAY ELSE o_orderdate + INTERVAL 7 DAY END::DATE::VARCHAR AS cursor_to,
  CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS applied, CASE WHEN o_orderkey % 5 = 0 THEN 730 ELSE o_orderkey % 5 END::INTEGER AS lookback, 14 AS overlap, CASE WHEN o_orderkey % 2 = 0 THEN repeat('a', 64) END AS digest FROM orders""")
def sync_states(spark, sf_dir):
    """Finished syncs move their cursor forwards only; persisted states are repaired."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    prior_to = F.when(k % 4 != 0, F.when(k % 3 == 0, day + F.expr("interval 7 days")).otherwise(day + F.expr("interval 2 days")))
    cursor = orderings.finalised(day - F.expr("interval 9 days"), prior_to, day, day + F.expr("interval 5 days"))
    good = F.repeat(F.lit("a"), F.lit(64))
    digest = F.when(k % 2 == 0, good).otherwise("nonsense")
    body = F.concat(F.lit('{"appliedFinancialEventDigests":["'), digest, F.lit('",null,"x"],"lastSuccessfulTo":"never","lookbackDays":"'), (k % 5).cast("string"), F.lit('","refreshOverlapDays":"-3","recordsDigest":"'), digest, F.lit('"}'))
    state = orderings.repaired_state(body)
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.to_date(cursor["from"]).cast("string").alias("cursor_from"), F.to_date(cursor["to"]).cast("string").alias("cursor_to"), F.size(state["applied"]).alias("applied"), state["lookback_days"].alias("lookback"), state["overlap_days"].alias("overlap"), state["records_digest"].alias("digest"))


# ---- identities --------------------------------------------------------------------------------------

_SHAPES = [" (Limited Edition)", " [180g vinyl]", " - Deluxe", " Vinyl Record", " (Live)", " on vinyl"]


@query("""WITH t AS (SELECT p_partkey AS k, p_size AS n, p_name AS t, lower(trim(regexp_replace(p_brand, '[^A-Za-z0-9]+', ' ', 'g'))) AS a, CASE p_size % 6 WHEN 4 THEN p_name || ' live' ELSE p_name END AS w,
  CASE p_size % 6 WHEN 0 THEN 'limited' WHEN 1 THEN '180g' WHEN 2 THEN 'deluxe' ELSE 'standard' END AS e FROM part)
SELECT k AS id, w AS release, CASE WHEN n % 10 = 0 THEN 'gtin:' || lpad(k::VARCHAR, 12, '9') WHEN n % 10 = 1 THEN 'url:s.example/products/' || k ELSE 'release:' || a || '|' || w || '|' || e || '|' || CASE WHEN n % 2 = 0 THEN 'new' ELSE 'used' END END AS pressing FROM t""")
def pressing_identities(spark, sf_dir):
    """Release titles without editions and formats, and identities of pressings: number, else release, else address."""
    n, k = F.col("p_size"), F.col("p_partkey").cast("string")
    title = F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name"), F.element_at(F.array(*[F.lit(s) for s in _SHAPES]), n % 6 + 1))
    artist = F.when(n % 10 == 1, "Unknown Artist").otherwise(F.col("p_brand"))
    code = F.when(n % 10 == 0, F.concat(F.lit("0"), F.lpad(k, 12, "9")))
    p = table(spark, sf_dir, "part")
    pressing = identities.pressing_identity([F.lit("12"), code], artist, title, F.when(n % 2 == 0, "Brand new").otherwise("VG"), F.concat(F.lit("https://www.s.example/collections/all/products/"), k, F.lit("?utm_source=x")))
    from ..functions.text import identity_text

    return p.select(F.col("p_partkey").alias("id"), identities.release_title(title, identity_text("p_brand")).alias("release"), pressing.alias("pressing"))


@query("""SELECT p_partkey AS id, p_name || CASE p_size % 4 WHEN 3 THEN ' (Live)' ELSE '' END AS shop_title, trim(regexp_replace(p_name, '\\bnew\\b', '')) || CASE p_size % 4 WHEN 3 THEN ' Live at' ELSE '' END AS searched, p_size % 3 <> 0 AND p_size % 5 <> 0 AS researchable, p_size % 4 IN (1, 2) AS conflict FROM part""")
def cleaned_titles(spark, sf_dir):
    """Titles as shops and research clean them, whether a find can be researched, and whether formats are in conflict."""
    n = F.col("p_size")
    shop = F.concat(F.lit("Best seller "), F.col("p_name"), F.element_at(F.array(*[F.lit(s) for s in (" Vinyl LP $19.99/ea", " [colored] was $29.99 (vinyl record sale)", " 2 LP deal", " (Live) - ")]), n % 4 + 1))
    search = F.concat(F.col("p_name"), F.element_at(F.array(*[F.lit(s) for s in (" Limited Edition Red Vinyl", " (Original Soundtrack) 180g", ": Music from somewhere at Target", " (Live) $19.99 [new] at Walmart")]), n % 4 + 1))
    sold = F.element_at(F.array(*[F.lit(s) for s in ("Album LP", "Album 2xLP", "Album box set", "Album vinyl")]), n % 4 + 1)
    good = identities.researchable(F.when(n % 3 == 0, "sitewide_sale"), F.when(n % 5 != 0, 3.0), "p_name", F.lit("Unknown Artist"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), identities.retail_title(shop).alias("shop_title"), identities.research_title(search).alias("searched"), good.alias("researchable"), identities.format_conflict(F.lit("Album vinyl LP"), sold).alias("conflict"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 < 2 THEN s_suppkey END AS release_id, CASE WHEN s_suppkey % 3 = 0 THEN 'Blue Moon' END AS matched_title,
  (CASE s_suppkey % 4 WHEN 0 THEN 100 + 24 + 25 WHEN 1 THEN 70 + 24 + 25 WHEN 2 THEN 12 ELSE 100 + 36 + 25 + 20 END + CASE WHEN s_suppkey % 2 = 0 THEN 10 ELSE -20 END)::INTEGER AS score,
  CASE s_suppkey % 4 WHEN 0 THEN 'https://s.example/i?filter=price' WHEN 1 THEN 'https://s.example/i' WHEN 2 THEN '[redacted delivery diagnostic]' ELSE 'plain' END AS shown, CASE s_suppkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 END::BIGINT AS comparables FROM supplier""")
def catalogue_references(spark, sf_dir):
    """References to catalogue entries, scores of catalogue numbers, texts without postal codes, and counts of comparable listings."""
    k = F.col("s_suppkey")
    value = F.when(k % 3 == 0, F.concat(F.lit(" /release/"), k.cast("string"), F.lit("-Blue-Moon#x"))).when(k % 3 == 1, F.concat(F.lit("https://discogs.com/de/release/"), k.cast("string"))).otherwise("https://elsewhere.example/release/5")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    score = identities.catalogue_score(pick(["AB-12", "AB-12", "AB-12", "AB-12-1"], k % 4), pick(["ab 12", "AB-123 AB 12", "AB-99", "AB12-1"], k % 4), F.when(k % 2 == 0, 1980).otherwise(2005))
    shown = pick(["https://s.example/i?filter=price,deliveryPostalCode:90210", "https://s.example/i?filter=deliveryPostalCode:90210", "sent to deliveryPostalCode 90210", "plain"], k % 4)
    page = lambda label, total: F.struct(F.lit(label).alias("label"), F.lit(total).cast("long").alias("total"))
    pages = F.when(k % 3 == 0, F.array(page("first", 3), page("discogs artist/title", 7))).when(k % 3 == 1, F.array(page("first", 3))).otherwise(F.array().cast("array<struct<label: string, total: bigint>>"))
    found = identities.release_reference(value)
    return table(spark, sf_dir, "supplier").select(k.alias("id"), found["release_id"].alias("release_id"), found["matched_title"].alias("matched_title"), score.cast("int").alias("score"), identities.redacted(shown).alias("shown"), orderings.comparable_count(pages).alias("comparables"))



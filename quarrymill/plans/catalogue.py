"""Queries over the supplied tables. Each function is a query; SQL holds its equivalent where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decisions, money, text, urls
from ..operators import aggregates, campaigns, matching, ranking, research
from ..sources import html as pages_html
from ..sources import tables as files
from ..streaming import lifecycle
from .adapters import AS_OF, SOLD_SQL, plain_sql, round_sql, sold_lines, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


# ---- sold history ------------------------------------------------------------------------------------

_SUMMARY_SQL = f"""
WITH {SOLD_SQL},
base AS (SELECT item, count(*) AS records, sum(units)::BIGINT AS units_sold, sum(gross)::BIGINT AS gross_units,
  coalesce(sum(units) FILTER (age BETWEEN 0 AND 30), 0)::BIGINT AS units_30, coalesce(sum(units) FILTER (age BETWEEN 0 AND 90), 0)::BIGINT AS units_90, coalesce(sum(units) FILTER (age BETWEEN 0 AND 365), 0)::BIGINT AS units_365,
  max(sale_date::DATE) FILTER (units > 0)::VARCHAR AS last_sale, sum(cents * units)::DOUBLE / nullif(sum(units), 0)::DOUBLE / 100.0::DOUBLE AS a FROM sold GROUP BY item),
by_value AS (SELECT item, cents, sum(units) AS w FROM sold WHERE units > 0 GROUP BY item, cents),
run AS (SELECT item, cents, sum(w) OVER (PARTITION BY item ORDER BY cents ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY item) AS tot FROM by_value),
ranks AS (SELECT item, min(cents) FILTER (run >= greatest(1, ceil(tot::DOUBLE * 0.25))) / 100.0::DOUBLE AS p25, min(cents) FILTER (run >= greatest(1, ceil(tot::DOUBLE * 0.5))) / 100.0::DOUBLE AS p50 FROM run GROUP BY item)
SELECT b.item, records, units_sold, gross_units, units_30, units_90, units_365, last_sale, coalesce({round_sql("a")}, 0) AS average_price, {round_sql("1 - units_sold::DOUBLE / gross_units::DOUBLE", 4)} AS refund_rate, p25, p50
FROM base b LEFT JOIN ranks r ON b.item = r.item"""


@query(_SUMMARY_SQL + " ORDER BY units_sold DESC, b.item LIMIT 20")
def sold_summary(spark, sf_dir):
    """The twenty items with most retained units, with windows, averages and weighted percentiles."""
    return sold_index(spark, sf_dir).orderBy(F.desc("units_sold"), "item").limit(20)


@query(_SUMMARY_SQL)
def sold_index(spark, sf_dir):
    """The same summary of every item."""
    return aggregates.sold_summary(sold_lines(spark, sf_dir), ["item"], AS_OF).withColumn("last_sale", F.col("last_sale").cast("string"))


@query(f"""WITH {SOLD_SQL} SELECT item, sum(CASE WHEN condition = 'new_sealed' THEN units ELSE 0 END)::BIGINT AS units_new_sealed, sum(CASE WHEN condition = 'used' THEN units ELSE 0 END)::BIGINT AS units_used,
  sum(CASE WHEN condition = 'unknown' THEN units ELSE 0 END)::BIGINT AS units_unknown FROM sold GROUP BY item""")
def sold_by_condition(spark, sf_dir):
    return aggregates.condition_units(sold_lines(spark, sf_dir), ["item"], ["new_sealed", "used", "unknown"])


@query(f"""WITH {SOLD_SQL}, m AS (SELECT item, condition, sum(units)::BIGINT AS units, sum(cents * units)::DOUBLE / nullif(sum(units), 0)::DOUBLE / 100.0::DOUBLE AS a FROM sold GROUP BY item, condition),
  grid AS (SELECT item, unnest(['new_sealed', 'used', 'unknown']) AS condition FROM (SELECT DISTINCT item FROM sold))
  SELECT item, condition, coalesce(units, 0)::BIGINT AS units, {round_sql('a')} AS average FROM grid LEFT JOIN m USING (item, condition)""")
def condition_metrics(spark, sf_dir):
    """Per item and condition, every condition present: the map flattened."""
    found = aggregates.condition_metrics(sold_lines(spark, sf_dir), ["item"], ["new_sealed", "used", "unknown"])
    return found.select("item", F.explode("by_condition").alias("condition", "m")).select("item", "condition", F.col("m.units").alias("units"), money.round_half_up("m.average").alias("average"))


@query(f"""WITH {SOLD_SQL}, r AS (SELECT lower(p_brand) AS artist, p_brand AS shown, p_name, units FROM sold JOIN part ON p_partkey = item),
  names AS (SELECT artist, shown, sum(units) AS u FROM r GROUP BY 1, 2), best AS (SELECT artist, first(shown ORDER BY u DESC, shown) AS artist_name FROM names GROUP BY artist)
  SELECT artist, count(DISTINCT p_name) AS releases, sum(units)::BIGINT AS units_sold, count(*) AS records, any_value(artist_name) AS artist_name FROM r JOIN best USING (artist) GROUP BY artist""")
def artist_rollup(spark, sf_dir):
    rows = sold_lines(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_brand", "p_name"), "item")
    return aggregates.artist_rollup(rows.withColumn("artist", F.lower("p_brand")), "artist", "p_brand", "p_name")


_ECON_SQL = f"""econ AS (SELECT o_orderpriority AS grp, cents AS paid, floor(cents::DOUBLE * 0.13 + 0.5)::BIGINT AS fees, CASE WHEN units = 0 THEN cents ELSE 0 END AS refund FROM sold JOIN orders ON o_orderkey = order_no)"""


@query(f"""WITH {SOLD_SQL}, {_ECON_SQL} SELECT grp, count(*) AS records, sum(paid)::BIGINT AS paid_cents, sum(fees)::BIGINT AS fee_cents, sum(refund)::BIGINT AS refund_cents, sum(paid - fees - refund)::BIGINT AS net_cents,
  count(*) FILTER (refund > 0) AS refunded, count(*) FILTER (refund >= paid * 0.95) AS fully_refunded FROM econ GROUP BY grp""")
def economics_by_group(spark, sf_dir):
    lines = sold_lines(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_no"), F.col("o_orderpriority").alias("grp")), "order_no")
    rows = lines.select("grp", F.col("cents").alias("paid"), F.floor(F.col("cents") * 0.13 + 0.5).cast("long").alias("fees"), F.when(F.col("units") == 0, F.col("cents")).otherwise(F.lit(0).cast("long")).alias("refund"))
    return aggregates.economics(rows, "grp")


@query(f"""WITH {SOLD_SQL} SELECT source, count(*) AS samples, quantile_disc(discount_cents, 0.25) AS p25, quantile_disc(discount_cents, 0.5) AS p50, quantile_disc(discount_cents, 0.75) AS p75, sum(discount_cents)::BIGINT AS total, max(sale_date::DATE)::VARCHAR AS latest FROM sold GROUP BY source""")
def calibration_percentiles(spark, sf_dir):
    rows = sold_lines(spark, sf_dir)
    ranks = aggregates.nearest_rank(rows.select("source", "discount_cents"), ["source"], "discount_cents", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("samples"), F.sum("discount_cents").alias("total"), F.max(F.to_date("sale_date")).cast("string").alias("latest")).join(ranks, "source")


# ---- prices, consensus, triage -----------------------------------------------------------------------

_PRICES_SQL = f"""listed AS (SELECT item, floor(cents / gross)::BIGINT AS unit, order_no, line_no, source FROM sold WHERE units > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY unit, order_no, line_no, source) AS r, count(*) OVER (PARTITION BY item) AS n FROM listed),
prices AS (SELECT item, count(*) AS listings, min(unit) / 100.0::DOUBLE AS least_price, (max(unit) - min(unit)) / 100.0::DOUBLE AS spread, avg(unit) FILTER (r <= 10) / 100.0::DOUBLE AS cheapest_ten, median(unit) / 100.0::DOUBLE AS median_price,
  median(unit) FILTER (n <= 2 OR (r > 1 AND r < n)) / 100.0::DOUBLE AS trimmed_median, count(*) FILTER (unit >= 300000) AS high_outliers FROM ranked GROUP BY item)"""


def _listed(spark, sf_dir):
    return sold_lines(spark, sf_dir).where("units > 0").select("item", F.floor(F.col("cents") / F.col("gross")).cast("long").alias("unit"), "order_no", "line_no", "source")


_SIX = ", ".join(f"round({c}, 6) AS {c}" for c in ("least_price", "spread", "cheapest_ten", "median_price", "trimmed_median"))


@query(f"WITH {SOLD_SQL}, {_PRICES_SQL} SELECT item, listings, {_SIX}, high_outliers FROM prices")
def price_summary(spark, sf_dir):
    found = aggregates.price_summary(_listed(spark, sf_dir), "item", "unit", 100_000)
    return found.select("item", "listings", *[F.round(c, 6).alias(c) for c in ("least_price", "spread", "cheapest_ten", "median_price", "trimmed_median")], "high_outliers")


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS seen FROM part GROUP BY 1, 2), t AS (SELECT p_brand, first(p_type ORDER BY n DESC, seen) AS consensus, max(n) AS votes, sum(n) AS total FROM c GROUP BY 1)
  SELECT p_brand, consensus, votes, """ + round_sql("votes::DOUBLE / total::DOUBLE", 4) + " AS share FROM t")
def consensus_mode(spark, sf_dir):
    return aggregates.consensus(table(spark, sf_dir, "part"), "p_brand", "p_type", "p_partkey")


_TRIAGE_SQL = f"""
WITH {SOLD_SQL}, {_PRICES_SQL},
x AS (SELECT *, coalesce(cheapest_ten, trimmed_median, median_price) / 200 AS bench, spread / 200 AS width, (item % 10) / 10.0::DOUBLE AS ratio, item % 3 AS flags FROM prices),
c AS (SELECT *, least(1.0, greatest(0.0, least(listings / 6.0::DOUBLE, 1.0) * 0.35 + ratio * 0.35 + 0.25 - least(flags * 0.08, 0.24) - CASE WHEN width > 20 THEN 0.2 ELSE 0 END)) AS conf FROM x)
SELECT item, CASE WHEN bench > 5 AND listings >= 4 THEN 'GREEN' WHEN listings >= 4 AND ratio >= 0.7 AND width <= 20 AND high_outliers = 0 AND flags = 0 AND bench <= 5 AND conf >= 0.72 THEN 'RED' ELSE 'YELLOW' END AS decision,
  round(CASE WHEN bench > 5 AND listings >= 4 THEN greatest(conf, CASE WHEN ratio >= 0.7 THEN 0.72 ELSE 0.62 END) ELSE conf END, 6) AS confidence FROM c"""


@query(_TRIAGE_SQL)
def triage_decision(spark, sf_dir):
    """Triage of every item on its price summary; cluster ratio and flags stand in from the key."""
    p = aggregates.price_summary(_listed(spark, sf_dir), "item", "unit", 100_000)
    p = p.withColumns({"bench": F.coalesce("cheapest_ten", "trimmed_median", "median_price") / 200, "width": F.col("spread") / 200, "ratio": (F.col("item") % 10) / 10.0, "flags": F.col("item") % 3})
    p = p.withColumn("conf", decisions.triage_confidence("listings", "ratio", "flags", "width"))
    out = decisions.triage("bench", "listings", "ratio", "flags", "width", "high_outliers", "conf")
    return p.select("item", out["decision"].alias("decision"), F.round(out["confidence"], 6).alias("confidence"))


_TITLE_WORDS_SQL = "list_filter(regexp_split_to_array(regexp_replace(replace(lower({}), '&', ' and '), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '' AND x NOT IN ('the','a','an','lp','vinyl','record','records','album','used'))"


@query(f"""WITH l AS (SELECT p_brand AS search, {_TITLE_WORDS_SQL.format("p_brand")} AS own, {_TITLE_WORDS_SQL.format("p_name || ' ' || p_brand || ' ' || p_type")} AS w, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part),
  e AS (SELECT search, own, unnest(w) AS token, unnest(range(0, len(w))) AS pos FROM l WHERE r <= 25), c AS (SELECT search, token, count(*) AS listings, min(pos)::INTEGER AS first_pos FROM e WHERE NOT list_contains(own, token) GROUP BY ALL HAVING count(*) >= 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY search ORDER BY listings DESC, first_pos, token) AS rank FROM c), b AS (SELECT * FROM k WHERE rank <= 5)
  SELECT search, token, listings, first_pos FROM b WHERE search IN (SELECT search FROM b GROUP BY 1 HAVING count(*) >= 2)""")
def expansion_tokens(spark, sf_dir):
    """The words that widen each search: of its first 25 listings, without the words of the search itself."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("search"), "p_partkey", text.word_list("p_brand").alias("own"), text.word_list(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("words"))
    return aggregates.expansion_tokens(p, "search", "words", [F.col("p_partkey")], "own")


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(replace(lower(text), '&', ' and '), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '' AND x NOT IN ('the','a','an','lp','vinyl','record','records','album','used')) AS w FROM documents),
  e AS (SELECT doc_id, unnest(w) AS token, unnest(range(0, len(w))) AS pos FROM t), c AS (SELECT token, count(DISTINCT doc_id) AS docs, min(pos) AS first_pos FROM e GROUP BY token)
  SELECT token, docs, first_pos FROM c WHERE docs >= 2 ORDER BY docs DESC, first_pos, token LIMIT 5""")
def expansion_tokens_whole(spark, sf_dir):
    """The five words in most documents, every word of every text counted. doc_id is the key of documents, so distinct words of
    a text need no shuffle by document: only sums of words move."""
    words = table(spark, sf_dir, "documents").select(text.word_list("text").alias("w"))
    first = words.select(F.posexplode("w").alias("pos", "token")).groupBy("token").agg(F.lit(0).cast("long").alias("docs"), F.min("pos").alias("pos"))
    docs = words.select(F.explode(F.array_distinct("w")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("docs"), F.lit(None).cast("int").alias("pos"))
    per = first.unionByName(docs).groupBy("token").agg(F.sum("docs").alias("docs"), F.min("pos").alias("first_pos"))
    return per.where("docs >= 2").orderBy(F.desc("docs"), "first_pos", "token").limit(5)


_KEYWORDS_SQL = ", ".join("('{}')".format(k.replace("'", "''")) for k in text.RISK_KEYWORDS)


@query(f"""WITH k(keyword) AS (VALUES {_KEYWORDS_SQL}) SELECT doc_id, keyword FROM documents, k WHERE contains(lower(text), keyword)""")
def risk_flags(spark, sf_dir):
    """Every risk keyword of every text: keywords are a literal array, no join."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.risk_keywords("text")).alias("keyword"))


# ---- ranking, dedup, selection -----------------------------------------------------------------------


@query(f"""WITH {SOLD_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY cents, source, order_no, line_no) AS r FROM sold) SELECT item, source, order_no, line_no, cents FROM o WHERE r = 1""")
def cheapest_offer_per_item(spark, sf_dir):
    best = ranking.best_per_key(sold_lines(spark, sf_dir), ["item"], [F.col("cents"), F.col("source"), F.col("order_no"), F.col("line_no")])
    return best.select("item", "source", "order_no", "line_no", "cents")


@query(f"""WITH {SOLD_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cents DESC, order_no, line_no, item) AS rank FROM sold) SELECT source, rank::INTEGER AS rank, item, order_no, line_no, cents FROM o WHERE rank <= 5""")
def top_n_per_source(spark, sf_dir):
    top = ranking.top_per_key(sold_lines(spark, sf_dir), ["source"], [F.desc("cents"), F.col("order_no"), F.col("line_no"), F.col("item")], 5)
    return top.select("source", "rank", "item", "order_no", "line_no", "cents")


@query(f"""WITH {SOLD_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cents DESC, order_no, line_no, item) AS turn FROM sold) SELECT turn::INTEGER AS turn, source, item, order_no, line_no FROM o ORDER BY turn, source LIMIT 150""")
def round_robin_sample(spark, sf_dir):
    return ranking.round_robin(sold_lines(spark, sf_dir), "source", [F.desc("cents"), F.col("order_no"), F.col("line_no"), F.col("item")], 150).select("turn", "source", "item", "order_no", "line_no")


@query(f"""WITH {SOLD_SQL}, c AS (SELECT condition, source, count(*) AS n FROM sold GROUP BY 1, 2), t AS (SELECT condition, sum(n)::BIGINT AS total, count(*) AS sources, max(n) AS most, sum(n * n)::BIGINT AS sq FROM c GROUP BY 1)
  SELECT condition, total, sources, {round_sql("most::DOUBLE / total::DOUBLE", 4)} AS largest_share, {round_sql("sq::DOUBLE / (total * total)::DOUBLE", 4)} AS hhi FROM t""")
def source_hhi(spark, sf_dir):
    return aggregates.concentration(sold_lines(spark, sf_dir), "condition", "source")


@query(f"""WITH {SOLD_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY units DESC, cents, order_no, line_no, source) AS r FROM sold),
  n AS (SELECT item, first(age ORDER BY r) FILTER (age IS NOT NULL AND age > 1000) AS age FROM b GROUP BY item) SELECT item, units, cents, n.age AS old_age FROM b JOIN n USING (item) WHERE r = 1""")
def merged_candidates(spark, sf_dir):
    """Best row of each item; its missing value is filled from the next best row that has one."""
    rows = sold_lines(spark, sf_dir).withColumn("old_age", F.when(F.col("age") > 1000, F.col("age")))
    order = [F.desc("units"), F.col("cents"), F.col("order_no"), F.col("line_no"), F.col("source")]
    return ranking.merged_best(rows, ["item"], order, ["old_age"]).select("item", "units", "cents", "old_age")


def _candidates(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), F.col("p_type").alias("family"))
    best = cheapest_offer_per_item(spark, sf_dir)
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), (F.col("s_nationkey") % 5).alias("nation_group"))
    rows = best.join(part, "item").join(supplier, "source")
    return rows.select(F.col("item").alias("id"), "source", F.concat_ws(":", F.lit("family"), "nation_group").alias("family"), (-F.col("cents")).alias("score"))


@query()
def diversity_select(spark, sf_dir):
    """Forty candidates under source and family caps; picks depend on earlier picks, so there is no SQL."""
    return ranking.diversity_select(_candidates(spark, sf_dir), 40)


@query(f"""WITH {SOLD_SQL}, w AS (SELECT order_no, line_no, item, source, cents, sum(cents) OVER (PARTITION BY order_no) AS tot, row_number() OVER (PARTITION BY order_no ORDER BY line_no, item, source) AS r, count(*) OVER (PARTITION BY order_no) AS n FROM sold),
  s AS (SELECT *, floor(1999 * cents / tot + 0.5)::BIGINT AS share FROM (SELECT * REPLACE (cents::DOUBLE AS cents, tot::DOUBLE AS tot) FROM w)),
  a AS (SELECT *, coalesce(sum(share) OVER (PARTITION BY order_no ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
  SELECT order_no, line_no, item, source, (CASE WHEN r = n THEN 1999 - before ELSE share END)::BIGINT AS allocated FROM a""")
def allocation_remainder(spark, sf_dir):
    rows = sold_lines(spark, sf_dir).withColumn("amount", F.lit(1999))
    return ranking.allocate(rows, ["order_no"], "cents", "amount", [F.col("line_no"), F.col("item"), F.col("source")]).select("order_no", "line_no", "item", "source", "allocated")


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) SELECT event_id, user_id, event_type FROM d WHERE r = 1""")
def dedupe_union(spark, sf_dir):
    """Two overlapping batches of events as one: the first row of each key stays."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    both = e.where("event_id % 3 <> 0").unionByName(e.where("event_id % 2 = 0 OR event_id % 3 = 0"))
    return ranking.first_wins(both.distinct(), ["user_id", "event_type"], "event_id")


@query("""WITH s AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, first(p_size ORDER BY n DESC, p_size) AS top_size, max(n) AS n FROM s GROUP BY 1""")
def highest_count_key(spark, sf_dir):
    per = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").count()
    return ranking.best_per_key(per, ["p_brand"], [F.desc("count"), F.col("p_size")]).select("p_brand", F.col("p_size").alias("top_size"), F.col("count").alias("n"))


# ---- joins -------------------------------------------------------------------------------------------

_WORDS_SQL = "list_sort(list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda x: x <> '')))"


def _title_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.filter(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "), lambda w: w != "").alias("words"))


_COMPS_SQL = f"""WITH p AS (SELECT p_partkey, {_WORDS_SQL} AS w FROM part), d AS (SELECT DISTINCT w FROM p),
  s AS (SELECT a.w AS qw, b.w AS cw, {round_sql("len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w))::DOUBLE", 4)} AS score FROM d a, d b WHERE len(a.w) > 1 AND len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w))::DOUBLE >= 0.65),
  r AS (SELECT q.p_partkey AS query_id, p.p_partkey AS item_id, score FROM s JOIN p q ON q.w = qw JOIN p ON p.w = cw WHERE q.p_partkey <> p.p_partkey), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM r)
  SELECT query_id, item_id, score, rank::INTEGER AS rank FROM k WHERE rank <= 3"""


@query(_COMPS_SQL)
def token_comp_match(spark, sf_dir):
    """The three best items of every part by shared title words."""
    p = _title_words(spark, sf_dir)
    return matching.token_match(p.withColumnRenamed("p_partkey", "query_id"), p.withColumnRenamed("p_partkey", "item_id"), "query_id", "item_id", "words")


@query(_COMPS_SQL)
def token_comp_match_all(spark, sf_dir):
    """The same under the name that it has had."""
    return token_comp_match(spark, sf_dir)


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')""")
def artist_confirm_semi(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(lines.where("l_returnflag = 'R'"), "o_orderkey", "left_semi").join(lines.where("l_linestatus = 'O'"), "o_orderkey", "left_anti")


@query("""SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) AND floor(c_acctbal) NOT IN (SELECT floor(s_acctbal) FROM supplier)""")
def self_exclusion_anti(spark, sf_dir):
    """Customers that share neither of two keys with any supplier: one anti join on exploded keys."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return matching.exclude_shared(c, s, [F.col("c_custkey"), F.floor("c_acctbal")], [F.col("s_suppkey"), F.floor("s_acctbal")]).select("c_custkey", "c_nationkey")


@query(f"""WITH i AS (SELECT p_partkey AS id, p_size AS source, p_type AS collection, p_retailprice AS price FROM part),
  c AS (SELECT s_suppkey AS campaign_id, (s_suppkey % 50)::INTEGER AS source, CASE WHEN s_suppkey % 2 = 0 THEN 'sitewide' ELSE 'collection' END AS scope, ['ECONOMY','STANDARD','PROMO','LARGE'][1 + (s_suppkey % 4)::INTEGER] AS scope_value, 10 + s_nationkey AS discount FROM supplier),
  j AS (SELECT i.id, i.source, i.price, campaign_id, discount, coalesce(scope_value = collection, false) AS exact, coalesce(scope_value = collection OR scope = 'sitewide', false) AS good FROM i LEFT JOIN c ON i.source = c.source),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY good DESC, exact DESC, discount DESC NULLS LAST, campaign_id NULLS LAST) AS n FROM j)
  SELECT id, source, price, CASE WHEN good THEN campaign_id END AS campaign_id, CASE WHEN good THEN {round_sql("price * (1 - discount / 100.0::DOUBLE)")} ELSE price END AS offer_price FROM r WHERE n = 1""")
def campaign_apply(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("source"), F.col("p_type").alias("collection"), F.col("p_retailprice").alias("price"))
    k = F.col("s_suppkey")
    offers = table(spark, sf_dir, "supplier").select(k.alias("campaign_id"), (k % 50).cast("int").alias("source"), F.when(k % 2 == 0, "sitewide").otherwise("collection").alias("scope"), F.element_at(F.array(*[F.lit(x) for x in ("ECONOMY", "STANDARD", "PROMO", "LARGE")]), (k % 4 + 1).cast("int")).alias("scope_value"), (F.col("s_nationkey") + 10).alias("discount"))
    return matching.apply_campaigns(items, offers, "id", "price")


@query("""WITH t AS (SELECT event_id AS txn_id, event_id * 3 AS order_id, (event_id % 9)::INTEGER AS line_id, event_id % 3000 AS item_id, event_type AS currency FROM events),
  l AS (SELECT l_orderkey AS order_id, l_linenumber AS line_id, l_partkey AS item_id, CASE WHEN l_returnflag = 'A' THEN 'click' ELSE 'purchase' END AS currency FROM lineitem),
  e AS (SELECT DISTINCT order_id, line_id, currency FROM l), o AS (SELECT DISTINCT order_id, currency FROM l), i AS (SELECT item_id, currency, min(line_id) AS il, min(order_id) AS io FROM l GROUP BY 1, 2 HAVING count(*) = 1)
  SELECT txn_id, t.order_id, t.line_id, t.item_id, t.currency, CASE WHEN e.order_id IS NOT NULL THEN 'line' WHEN o.order_id IS NOT NULL THEN 'order' WHEN i.item_id IS NOT NULL THEN 'item' ELSE 'none' END AS target,
    CASE WHEN e.order_id IS NOT NULL OR o.order_id IS NOT NULL THEN t.order_id ELSE io END AS target_order, CASE WHEN e.order_id IS NOT NULL THEN t.line_id WHEN o.order_id IS NULL THEN il END AS target_line
  FROM t LEFT JOIN e ON e.order_id = t.order_id AND e.line_id = t.line_id AND e.currency = t.currency LEFT JOIN o ON o.order_id = t.order_id AND o.currency = t.currency LEFT JOIN i ON i.item_id = t.item_id AND i.currency = t.currency""")
def attribution_cascade(spark, sf_dir):
    e = F.col("event_id")
    txns = table(spark, sf_dir, "events").select(e.alias("txn_id"), (e * 3).alias("order_id"), (e % 9).cast("int").alias("line_id"), (e % 3000).alias("item_id"), F.col("event_type").alias("currency"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_id"), F.col("l_partkey").alias("item_id"), F.when(F.col("l_returnflag") == "A", "click").otherwise("purchase").alias("currency"))
    return matching.attribution_cascade(txns, lines)


@query("""WITH old AS (SELECT o_orderkey, o_orderdate::DATE AS day, o_totalprice AS price, o_orderstatus AS note FROM orders),
  fresh AS (SELECT o_orderkey, o_orderdate::DATE AS day, o_totalprice + 1 AS price, NULL::VARCHAR AS note FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND o_orderkey % 5 <> 0)
  SELECT o_orderkey, (CASE WHEN f.o_orderkey IS NOT NULL THEN f.day ELSE o.day END)::VARCHAR AS day, CASE WHEN f.o_orderkey IS NOT NULL THEN f.price ELSE o.price END AS price, CASE WHEN f.o_orderkey IS NOT NULL THEN coalesce(f.note, o.note) ELSE o.note END AS note
  FROM old o LEFT JOIN fresh f USING (o_orderkey) WHERE f.o_orderkey IS NOT NULL OR NOT (o.day BETWEEN DATE '1997-01-01' AND DATE '1998-12-31')""")
def range_replace_merge(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("note"))
    first, last = F.lit("1997-01-01").cast("date"), F.lit("1998-12-31").cast("date")
    fresh = old.where(F.col("day").between(first, last) & (F.col("o_orderkey") % 5 != 0)).withColumns({"price": F.col("price") + 1, "note": F.lit(None).cast("string")})
    return matching.range_replace(old, fresh, ["o_orderkey"], "day", first, last, ["note"]).withColumn("day", F.col("day").cast("string"))


@query("""SELECT c_custkey AS id, c_name AS name, 'fresh' AS origin FROM customer WHERE c_custkey % 2 = 0 UNION ALL
  SELECT c_custkey, c_name, 'base' FROM customer c WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AND NOT EXISTS (SELECT 1 FROM customer f WHERE f.c_custkey % 2 = 0 AND f.c_nationkey = c.c_nationkey AND f.c_mktsegment = c.c_mktsegment AND floor(f.c_acctbal / 100) = floor(c.c_acctbal / 100))""")
def baseline_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s"), F.floor(F.col("c_acctbal") / 100).alias("b"))
    return matching.baseline_union(c.where("id % 2 = 0").withColumn("origin", F.lit("fresh")), c.withColumn("origin", F.lit("base")), [["id"], ["n", "s", "b"]]).select("id", "name", "origin")


@query("""WITH c AS (SELECT s_suppkey AS id, s_nationkey AS guard, CASE WHEN s_suppkey % 3 = 0 THEN 'dismissed' END AS state FROM supplier) SELECT id, CASE WHEN id % 4 = 0 THEN guard + 1 ELSE guard END AS guard, CASE WHEN id % 4 <> 0 THEN state END AS state FROM c""")
def dismissal_carry_over(spark, sf_dir):
    """State follows a row only while its guard is unchanged."""
    k = F.col("s_suppkey")
    old = table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("guard"), F.when(k % 3 == 0, "dismissed").alias("state"))
    fresh = old.select("id", F.when(F.col("id") % 4 == 0, F.col("guard") + 1).otherwise(F.col("guard")).alias("guard"))
    return matching.carried_over(old, fresh, "id", "guard", "state")


@query("""WITH RECURSIVE r AS (SELECT p_partkey AS id, 'n' || p_name || '|' || p_brand || '|' || p_size AS a, 's' || p_type || '|' || p_size || '|' || p_brand || '|' || length(p_name) AS b FROM part),
  k AS (SELECT id, a AS key FROM r UNION ALL SELECT id, b FROM r), e AS (SELECT DISTINCT x.id AS x, y.id AS y FROM k x JOIN k y USING (key)),
  reach AS (SELECT id AS x, id AS y FROM r UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x) SELECT x AS id, min(y) AS "group" FROM reach GROUP BY x""")
def transitive_dedup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size, length = F.col("p_size").cast("string"), F.length("p_name").cast("string")
    rows = p.select(F.col("p_partkey").alias("id"), F.concat_ws("|", "p_name", "p_brand", size).alias("a"), F.concat_ws("|", "p_type", size, "p_brand", length).alias("b"))
    return matching.transitive_groups(rows, "id", ["a", "b"])


@query("""WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM documents), t AS (SELECT ['the', 'and', 'of', 'limited', 'deluxe'] AS e)
  SELECT doc_id, array_to_string(list_sort(list_filter(e, lambda x: NOT list_contains(w, x))), ',') AS missing, array_to_string(list_sort(list_intersect(e, w)), ',') AS common FROM w, t""")
def edition_set_difference(spark, sf_dir):
    want = F.array(*[F.lit(x) for x in ("the", "and", "of", "limited", "deluxe")])
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select("doc_id", F.array_join(F.array_sort(F.array_except(want, "w")), ",").alias("missing"), F.array_join(F.array_sort(F.array_intersect(want, "w")), ",").alias("common"))


# ---- decisions ---------------------------------------------------------------------------------------

_LEDGER_SQL = f"""i AS (SELECT p_partkey AS id, {plain_sql("p_retailprice / 100")} AS price, {plain_sql("p_retailprice / 100 * (1 + p_size / 25.0::DOUBLE)")} AS resale FROM part),
  l1 AS (SELECT *, {round_sql("price * (9.5::DOUBLE / 100)")} AS sales_tax, {round_sql("(resale * 0.15::DOUBLE + 0.3::DOUBLE)")} AS marketplace_fee, {round_sql("resale * 0.02::DOUBLE")} AS promoted_fee, {round_sql("(resale * 0.03::DOUBLE + 0.0::DOUBLE)")} AS returns_reserve FROM i),
  l2 AS (SELECT *, {round_sql("(price + sales_tax + 5.0::DOUBLE + 0 + 0 + 0)")} AS landed_cost, {round_sql("(marketplace_fee + promoted_fee + 6.0::DOUBLE + 1.0::DOUBLE + returns_reserve + 0)")} AS selling_costs FROM l1),
  l3 AS (SELECT *, {round_sql("(landed_cost + selling_costs)")} AS total_cost FROM l2), l4 AS (SELECT *, {round_sql("(resale - total_cost)")} AS net_profit FROM l3),
  ledger AS (SELECT *, CASE WHEN landed_cost > 0 THEN {round_sql("(net_profit / landed_cost)", 4)} END AS roi_ratio, CASE WHEN resale > 0 THEN {round_sql("(net_profit / resale)", 4)} END AS margin_ratio FROM l4)"""


def _priced(spark, sf_dir):
    p = F.col("p_retailprice") / 100
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), money.round_plain(p).alias("price"), money.round_plain(p * (1 + F.col("p_size") / 25.0)).alias("resale"))
    return decisions.with_ledger(rows, "price", "resale")


@query(f"WITH {_LEDGER_SQL} SELECT id, price, resale, sales_tax, marketplace_fee, promoted_fee, returns_reserve, landed_cost, selling_costs, total_cost, net_profit, roi_ratio, margin_ratio FROM ledger")
def cost_ledger(spark, sf_dir):
    return _priced(spark, sf_dir)


@query(f"""WITH i AS (SELECT p_partkey AS id, {plain_sql("p_retailprice / 100 * (1 + p_size / 25.0::DOUBLE)")} AS resale FROM part),
  c AS (SELECT id, resale, unnest(range(0, floor(resale * 100)::BIGINT + 1)) / 100.0::DOUBLE AS p FROM i), l AS (SELECT *, {round_sql(f"p + {round_sql('p * (9.5::DOUBLE / 100)')} + 5")} AS landed FROM c),
  g AS (SELECT *, {round_sql(f"resale - {round_sql(f'landed + {round_sql(chr(40) + round_sql(chr(40) + 'resale * 0.15::DOUBLE + 0.3::DOUBLE' + chr(41)) + ' + ' + round_sql('resale * 0.02::DOUBLE') + ' + 6 + 1 + ' + round_sql('resale * 0.03::DOUBLE') + chr(41))}')}")} AS net FROM l),
  t AS (SELECT id, max(p) AS top FROM g WHERE net >= 7 AND {round_sql("net / landed", 4)} >= 0.3 GROUP BY id) SELECT id, resale, coalesce(top, 0)::DOUBLE AS max_price FROM i LEFT JOIN t USING (id)""")
def max_purchase_price(spark, sf_dir):
    """Highest price at which profit and return still hold, by bisection over the ledger; the SQL scans all cents."""
    p = F.col("p_retailprice") / 100
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), money.round_plain(p * (1 + F.col("p_size") / 25.0)).alias("resale")).withColumn("max_price", decisions.max_purchase_price("resale"))


@query(f"""WITH {SOLD_SQL}, {_LEDGER_SQL}, u AS (SELECT item, coalesce(sum(units) FILTER (age BETWEEN 0 AND 90), 0)::DOUBLE AS u90, coalesce(sum(units) FILTER (age BETWEEN 0 AND 365), 0)::DOUBLE AS u365, coalesce(sum(units) FILTER (age BETWEEN 0 AND 1095), 0)::DOUBLE AS u1095, min(age) FILTER (units > 0) AS last_age, count(DISTINCT source) AS active FROM sold GROUP BY item),
  m AS (SELECT l.*, u.*, CASE WHEN u90 + active > 0 THEN {round_sql("(u90 / (u90 + active))", 4)} END AS st, {round_sql("(u90 / 3.0::DOUBLE)")} AS spm, {round_sql("(u1095 / 36.0::DOUBLE)")} AS ltm FROM ledger l JOIN u ON item = id),
  s AS (SELECT *, CASE WHEN spm > 0 THEN {round_sql("(active / spm)")} END AS months FROM m),
  d AS (SELECT *, CASE WHEN active = 0 AND u90 > 0 THEN 7.0 WHEN months IS NOT NULL THEN greatest(7.0, floor(months * 30 + 0.5)) END AS days FROM s),
  e AS (SELECT *, {round_sql("(net_profit * 30 / days)")} AS pp30,
    coalesce((u90 >= 6 AND spm >= 2 AND coalesce(last_age <= 45, false) AND st >= 0.3 AND net_profit >= 4 AND roi_ratio >= 0.2 AND days <= 45) OR (u90 >= 3 AND spm >= 1 AND coalesce(last_age <= 60, false) AND st >= 0.2 AND net_profit >= 7 AND roi_ratio >= 0.3 AND days <= 120)
    OR (u365 >= 6 AND coalesce(last_age <= 120, false) AND ltm >= 0.15 AND net_profit >= 12 AND roi_ratio >= 0.5 AND days <= 270), false) AS eligible FROM d),
  p AS (SELECT *, floor(least(30.0, least(12.0, greatest(0.0, spm * 12.0 / 4.0)) + least(8.0, greatest(0.0, u365 * 8.0 / 12.0)) + least(6.0, greatest(0.0, ltm * 6.0)) + CASE WHEN last_age <= 30 THEN 4 WHEN last_age <= 60 THEN 3 WHEN last_age <= 120 THEN 2 WHEN last_age <= 365 THEN 1 ELSE 0 END)
    + least(30.0, least(20.0, greatest(0.0, net_profit * 20.0 / 12.0)) + least(8.0, greatest(0.0, roi_ratio * 8.0 / 0.6)) + CASE WHEN pp30 IS NULL THEN 0 ELSE least(2.0, greatest(0.0, pp30 * 2.0 / 8.0)) END)
    + CASE WHEN u365 <= 0 THEN 0 WHEN active = 0 THEN 20 WHEN months <= 1 THEN 20 WHEN months <= 3 THEN 17 WHEN months <= 6 THEN 13 WHEN months <= 12 THEN 8 WHEN months <= 24 THEN 3 ELSE 0 END + 0.5)::BIGINT AS score FROM e)
  SELECT id, score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS band, eligible,
    CASE WHEN net_profit < 0 OR roi_ratio < 0 THEN 'REJECT' WHEN active > 50 AND days > 270 THEN 'REJECT' WHEN u365 = 0 THEN 'REVIEW' WHEN eligible AND score >= 65 THEN 'BUY' WHEN eligible AND score >= 50 THEN 'REVIEW' WHEN eligible THEN 'WATCH' WHEN net_profit >= 5 AND roi_ratio >= 0.15 AND resale >= 10 THEN 'WATCH' ELSE 'REJECT' END AS decision FROM p""")
def opportunity_decision(spark, sf_dir):
    """Ledger, velocity, strategies, score and decision of every item."""
    sold = sold_lines(spark, sf_dir)
    window = lambda n: F.coalesce(F.sum(F.when(F.col("age").between(0, n), F.col("units"))), F.lit(0)).cast("double")
    u = sold.groupBy("item").agg(window(90).alias("u90"), window(365).alias("u365"), window(1095).alias("u1095"), F.min(F.when(F.col("units") > 0, F.col("age"))).alias("last_age"), F.count_distinct("source").alias("active"))
    f = decisions.with_market(_priced(spark, sf_dir).join(u, F.col("id") == F.col("item")), "u90", "u365", "u1095", "active")
    f = f.withColumn("pp30", money.round_half_up(F.col("net_profit") * 30 / F.col("days_to_sell")))
    plans = decisions.strategies("net_profit", "roi_ratio", "u90", "u365", "sales_per_month", "sell_through", "last_age", "long_term_per_month", "days_to_sell")
    f = f.withColumn("eligible", plans["fast_turn"] | plans["balanced"] | plans["high_margin"])
    f = f.withColumn("score", decisions.priority_score("net_profit", "roi_ratio", "pp30", "sales_per_month", "u365", "long_term_per_month", "last_age", "supply_months", "active"))
    watch = (F.col("net_profit") >= decisions.SETTINGS["watch_net"]) & (F.col("roi_ratio") >= decisions.SETTINGS["watch_roi"])
    return f.select("id", "score", decisions.band("score").alias("band"), "eligible", decisions.buy_decision("net_profit", "roi_ratio", "active", "days_to_sell", "score", F.col("eligible"), watch, "resale", F.col("u365") == 0).alias("decision"))


@query(f"""WITH {SOLD_SQL}, {_PRICES_SQL}, x AS (SELECT item, p_retailprice AS price, coalesce(cheapest_ten, trimmed_median) / 20 AS bench, listings AS n, (item % 200) AS active FROM prices JOIN part ON p_partkey = item),
  d AS (SELECT *, CASE WHEN n >= 4 THEN {plain_sql("price - bench")} END AS dv FROM x), e AS (SELECT *, CASE WHEN n >= 4 THEN {plain_sql("dv / bench * 100")} END AS dp FROM d)
  SELECT item, round(dv, 4) AS delta_value, round(dp, 4) AS delta_percent, CASE WHEN n < 10 THEN 'NEEDS_REVIEW' WHEN dp > 25 AND active >= 150 THEN 'VERY_CROWDED' WHEN dp > 25 AND active >= 50 THEN 'CROWDED' WHEN dp > 25 THEN 'PRICE_HIGH' WHEN dp < -20 THEN 'PRICE_LOW' ELSE 'OK' END AS status FROM e""")
def seller_status(spark, sf_dir):
    p = aggregates.price_summary(_listed(spark, sf_dir), "item", "unit").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("price")), "item")
    p = p.withColumns({"bench": F.coalesce("cheapest_ten", "trimmed_median") / 20, "active": F.col("item") % 200})
    out = decisions.seller_status("price", "bench", "listings", "active")
    return p.select("item", F.round(out["delta_value"], 4).alias("delta_value"), F.round(out["delta_percent"], 4).alias("delta_percent"), out["status"].alias("status"))


@query("""WITH i AS (SELECT p_partkey AS id, p_retailprice / 40 AS m, CASE WHEN p_size % 2 = 0 THEN p_retailprice / 50 END AS ten, CASE WHEN p_size % 3 = 0 THEN p_retailprice / 45 END AS guide, p_size * 2 AS n FROM part),
  s AS (SELECT *, CASE WHEN m < 5 THEN 0.5 ELSE floor(m * 0.4 * 2) / 2 END AS buy_price, floor(CASE WHEN n > 50 AND ten IS NOT NULL THEN ten * 0.7 WHEN n > 10 THEN coalesce(guide, m) * 0.8 ELSE m * 1.1 END * 2) / 2 AS sale_price FROM i),
  f AS (SELECT *, floor(sale_price * 0.1825 * 2) / 2 AS fees FROM s), b AS (SELECT *, sale_price - buy_price - fees - 1 AS pre_tax FROM f), t AS (SELECT *, floor(greatest(0, pre_tax) * 0.153 * 2) / 2 AS tax FROM b)
  SELECT id, buy_price::DOUBLE AS buy_price, sale_price::DOUBLE AS sale_price, fees::DOUBLE AS fees, pre_tax::DOUBLE AS pre_tax, tax::DOUBLE AS tax, (floor((pre_tax - tax) * 2) / 2)::DOUBLE AS profit, CASE WHEN m < 5 THEN 'under_5' WHEN m <= 25 THEN '5_to_25' ELSE 'over_25' END AS category FROM t""")
def bulk_buy(spark, sf_dir):
    r, size = F.col("p_retailprice"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (r / 40).alias("m"), F.when(size % 2 == 0, r / 50).alias("ten"), F.when(size % 3 == 0, r / 45).alias("guide"), (size * 2).alias("n"))
    return rows.select("id", *[c.alias(n) for n, c in decisions.bulk_buy("m", "ten", "guide", "n").items()])


@query(f"""WITH s AS (SELECT n_regionkey AS region, s_suppkey % 7 <> 0 AS catalog_ok, s_suppkey % 3 <> 0 AS productive, s_suppkey % 2 = 0 AS sale_ok, s_suppkey % 97 = 0 AS blocked FROM supplier JOIN nation ON n_nationkey = s_nationkey),
  a AS (SELECT region, count(*) AS sources, {round_sql("(count(*) FILTER (catalog_ok)::DOUBLE / count(*)::DOUBLE)", 4)} AS catalog, {round_sql("(count(*) FILTER (productive)::DOUBLE / count(*)::DOUBLE)", 4)} AS productive, {round_sql("(count(*) FILTER (sale_ok)::DOUBLE / count(*)::DOUBLE)", 4)} AS sale, count(*) FILTER (blocked) AS blocked FROM s GROUP BY region)
  SELECT *, CASE WHEN sources = 0 OR catalog < 0.70 OR productive < 0.30 THEN 'blocked' WHEN catalog < 0.85 OR productive < 0.40 OR sale < 0.45 OR blocked > 0 THEN 'degraded' ELSE 'healthy' END AS status, NOT (sources = 0 OR catalog < 0.70 OR productive < 0.30) AS publishable FROM a""")
def run_quality(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k, n = F.col("s_suppkey"), F.count(F.lit(1))
    share = lambda c: money.round_half_up(F.count_if(c) / n, 4)
    a = s.groupBy(F.col("n_regionkey").alias("region")).agg(n.alias("sources"), share(k % 7 != 0).alias("catalog"), share(k % 3 != 0).alias("productive"), share(k % 2 == 0).alias("sale"), F.count_if(k % 97 == 0).alias("blocked"))
    out = decisions.run_status("sources", "catalog", "productive", "sale", "blocked", F.lit(0))
    return a.select("*", out["status"].alias("status"), out["publishable"].alias("publishable"))


# ---- text and URLs -----------------------------------------------------------------------------------


@query("""WITH t AS (SELECT p_partkey AS id, p_brand || ' - ' || p_name || CASE WHEN p_size % 3 = 0 THEN ' LP Sealed' WHEN p_size % 3 = 1 THEN ' VG+/NM 180g vinyl record' ELSE '' END AS title FROM part),
  c AS (SELECT id, title, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '(?i)\\b(factory\\s+sealed|sealed)\\b', ' ', 'g'), '(?i)\\b(VG\\+)\\s*/\\s*(NM)', ' ', 'g'), '(?i)\\bvinyl\\s+record\\b', ' ', 'g'), '(?i)\\b\\d+\\s*(gram|grams|g)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM t),
  a AS (SELECT id, title, regexp_extract(clean, '^(.{2,80}?)\\s+-\\s+(.{2,})$', 1) AS artist, regexp_extract(clean, '^(.{2,80}?)\\s+-\\s+(.{2,})$', 2) AS release FROM c),
  n AS (SELECT id, title, array_to_string(list_filter(string_split_regex(regexp_replace(lower(artist), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x NOT IN ('', 'lp', 'the')), ' ') AS na, array_to_string(list_filter(string_split_regex(regexp_replace(lower(release), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x NOT IN ('', 'lp', 'the')), ' ') AS nr FROM a)
  SELECT id, na || '::' || nr AS sold_key, CASE WHEN title LIKE '%Sealed%' THEN 'new_sealed' WHEN title LIKE '%VG+/NM%' THEN 'used' ELSE 'unknown' END AS condition, CASE WHEN title LIKE '%VG+/NM%' THEN 'VG+' END AS media, CASE WHEN title LIKE '%VG+/NM%' THEN 'NM' END AS sleeve FROM n""")
def sold_identity(spark, sf_dir):
    """Group key, condition and grades of listing titles."""
    size = F.col("p_size") % 3
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.concat_ws(" - ", "p_brand", "p_name"), F.when(size == 0, " LP Sealed").when(size == 1, " VG+/NM 180g vinyl record").otherwise("")).alias("title"))
    g = text.grades("title")
    return t.select("id", text.sold_key("title").alias("sold_key"), text.sold_condition("title").alias("condition"), g["media"].alias("media"), g["sleeve"].alias("sleeve"))


@query("""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '') || (CASE WHEN regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') END)
  || CASE WHEN regexp_matches(url, '[?&]variant=') THEN '?' || regexp_extract(url, '[?&](variant=[^&#]*)', 1) ELSE '' END AS product FROM pages""")
def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.product_identity("url").alias("product"))


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href=["'']([^"''>]+)["''][^>]*>.{0,500}?</a>', 1)) AS href, unnest(range(0, len(regexp_extract_all(html, '(?is)<a\\s[^>]*href=["'']([^"''>]+)["''][^>]*>.{0,500}?</a>', 1)))) AS position FROM pages) SELECT page_id, position::INTEGER AS position, href FROM a""")
def html_anchors(spark, sf_dir):
    return pages_html.anchors(table(spark, sf_dir, "pages"), "page_id").select("page_id", "position", "href")


@query()
def html_prices(spark, sf_dir):
    """Dollar amounts of pages away from words about shipping or coupons (look-around: no SQL)."""
    found = table(spark, sf_dir, "pages").select("page_id", pages_html.prices("html").alias("p"))
    return found.where(F.size("p") > 0).select("page_id", F.array_min("p").alias("price"), F.array_max("p").alias("original"))


@query()
def html_next_links(spark, sf_dir):
    """The five best pagination links of each page."""
    return pages_html.scored_links(table(spark, sf_dir, "pages"), "page_id", "url", [*pages_html.PAGINATION, ("href", "^/", 1)], 1, 5)


@query()
def json_ld_products(spark, sf_dir):
    """Products in ld+json scripts of pages; pages without any give no rows."""
    return pages_html.json_ld_products(table(spark, sf_dir, "pages"), "page_id")


# ---- stateful ----------------------------------------------------------------------------------------


def _observations(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("run", F.date_format("ts", "yyyy-MM-dd"))
    first = ranking.best_per_key(e, ["user_id", "run"], [F.col("event_id")])
    return first.select(F.col("user_id").cast("string").alias("campaign"), "run", F.col("event_type").alias("content"))


@query("""WITH RECURSIVE d AS (SELECT *, strftime(ts, '%Y-%m-%d') AS run, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS r FROM events),
  runs AS (SELECT run, row_number() OVER (ORDER BY run) AS n FROM (SELECT DISTINCT run FROM d)), o AS (SELECT user_id, n, event_type AS content FROM d JOIN runs USING (run) WHERE r = 1),
  s AS (SELECT user_id, n, content, 'new' AS status, 1 AS scans, 1 AS consecutive, 0 AS misses FROM (SELECT *, min(n) OVER (PARTITION BY user_id) AS f FROM o) WHERE n = f
    UNION ALL SELECT s.user_id, s.n + 1, coalesce(o.content, s.content),
      CASE WHEN o.content IS NOT NULL AND s.status = 'ended' THEN 'new' WHEN o.content IS NOT NULL AND o.content <> s.content THEN 'changed' WHEN o.content IS NOT NULL AND s.misses = 0 AND s.consecutive >= 4 THEN 'evergreen'
        WHEN o.content IS NOT NULL THEN 'ongoing' WHEN s.status = 'ended' OR s.misses >= 1 THEN 'ended' WHEN s.scans >= 5 OR s.status = 'evergreen' THEN 'evergreen' ELSE 'ongoing' END,
      s.scans + CASE WHEN o.content IS NULL THEN 0 ELSE 1 END, CASE WHEN o.content IS NULL THEN s.consecutive WHEN s.status = 'ended' OR s.misses > 0 THEN 1 ELSE s.consecutive + 1 END,
      CASE WHEN o.content IS NOT NULL THEN 0 WHEN s.status = 'ended' THEN s.misses ELSE s.misses + 1 END
    FROM s LEFT JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1 WHERE s.n < (SELECT max(n) FROM runs))
  SELECT user_id::VARCHAR AS campaign, run, status, scans, consecutive, misses FROM s JOIN runs USING (n)""")
def campaign_lifecycle(spark, sf_dir):
    """Users as campaigns and days as runs: every campaign's status after every run of the table."""
    seen = _observations(spark, sf_dir)
    runs = [r.run for r in seen.select("run").distinct().orderBy("run").collect()]  # the days of the table
    return lifecycle.replay(seen, runs)


@query("""SELECT event_id, user_id, sha256(event_type || '|' || user_id) AS digest FROM events WHERE event_id % 4 <> 0""")
def exactly_once_events(spark, sf_dir):
    """Events that the state hasn't applied; repeats in the batch count once, changed content would stop the job."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string")), 256).alias("digest"))
    applied = e.where("event_id % 4 = 0").select("event_id", "digest")
    return lifecycle.apply_once(e.unionByName(e.where("event_id % 5 = 0")), applied, "event_id", "digest").select("event_id", "user_id", "digest")


@query("""WITH d AS (SELECT unnest(range(0, 3)) AS k) SELECT (TIMESTAMP '2024-01-01' + k * INTERVAL 90 DAY) AS "from", least(TIMESTAMP '2024-01-01' + (k + 1) * INTERVAL 90 DAY - INTERVAL 1 MILLISECOND, TIMESTAMP '2024-07-15') AS "to" FROM d""")
def date_slices(spark, sf_dir):
    return files.date_slices(spark, "2024-01-01", "2024-07-15", 90)


# ---- campaigns and research --------------------------------------------------------------------------

_OBS_SQL = """obs AS (SELECT event_id AS id, user_id AS base, CASE WHEN value >= 1 THEN floor(value)::BIGINT % 7 END AS discount, event_id % 5 = 0 AS verified, 'page' || event_id % 11 AS url, ts AS seen_at, 1 + event_id % 3 AS seen FROM events)"""


def _campaign_rows(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("id"), F.col("user_id").alias("base"), F.when(F.col("value") >= 1, F.floor("value") % 7).alias("discount"), (e % 5 == 0).alias("verified"), F.concat(F.lit("page"), (e % 11).cast("string")).alias("url"), F.col("ts").alias("seen_at"), (e % 3 + 1).alias("seen"))


_ELIGIBLE_SQL = """eligible AS (SELECT * FROM obs o WHERE verified OR NOT EXISTS (SELECT 1 FROM obs c WHERE c.verified AND c.base = o.base) OR EXISTS (SELECT 1 FROM obs c WHERE c.verified AND c.base = o.base AND c.discount IS NOT DISTINCT FROM o.discount))"""


@query(f"WITH {_OBS_SQL}, {_ELIGIBLE_SQL} SELECT id, base, discount, verified FROM eligible")
def conflicting_leads(spark, sf_dir):
    return campaigns.eligible_observations(_campaign_rows(spark, sf_dir), ["base"], ["discount"]).select("id", "base", "discount", "verified")


@query(f"""WITH {_OBS_SQL}, {_ELIGIBLE_SQL}, f AS (SELECT *, coalesce(discount, -1) AS d FROM eligible), r AS (SELECT *, row_number() OVER (PARTITION BY base, d ORDER BY (CASE WHEN verified THEN 1000000 ELSE 0 END) + length(url) DESC, id) AS n FROM f),
  s AS (SELECT base, d, sum(seen)::BIGINT AS observations, count(DISTINCT url) AS pages, min(seen_at)::DATE::VARCHAR AS first_day, max(seen_at)::DATE::VARCHAR AS last_day FROM f GROUP BY 1, 2)
  SELECT base, d, id, observations, pages, first_day, last_day FROM r JOIN s USING (base, d) WHERE n = 1""")
def merged_observations(spark, sf_dir):
    """One representative of each campaign and discount, with its observations counted."""
    rows = campaigns.eligible_observations(_campaign_rows(spark, sf_dir), ["base"], ["discount"]).withColumn("d", F.coalesce("discount", F.lit(-1).cast("long")))
    out = campaigns.merged_observations(rows, ["base", "d"], F.when(F.col("verified"), 1_000_000).otherwise(0) + F.length("url"), [F.col("id")])
    day = lambda c: F.to_date(c).cast("string")
    return out.select("base", "d", "id", "observations", "pages", day("first_seen").alias("first_day"), day("last_seen").alias("last_day"))


@query("""WITH s AS (SELECT s_suppkey AS id, s_suppkey % 4 = 0 AS meaningful, s_suppkey % 7 = 0 AS failed, s_suppkey % 5 = 0 AS sale_failed, s_suppkey % 3 = 0 AS partial, s_suppkey % 2 = 0 AS reached, s_suppkey % 11 = 0 AS cat_failed, s_suppkey % 6 <> 1 AS attempted FROM supplier),
  c AS (SELECT CASE WHEN meaningful AND (failed OR sale_failed OR partial) THEN 'degraded' WHEN meaningful THEN 'healthy' WHEN sale_failed AND reached AND NOT cat_failed THEN 'degraded' WHEN sale_failed OR failed THEN 'blocked' WHEN attempted THEN 'empty' ELSE 'not_checked' END AS state FROM s)
  SELECT state, count(*) AS sources FROM c GROUP BY state""")
def source_coverage(spark, sf_dir):
    k = F.col("s_suppkey")
    state = campaigns.source_coverage(k % 4 == 0, k % 7 == 0, k % 5 == 0, k % 3 == 0, k % 2 == 0, k % 11 == 0, k % 6 != 1)
    return table(spark, sf_dir, "supplier").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("sources"))


_EVIDENCE_SQL = f"""rr AS (SELECT l_partkey AS find, l_suppkey AS run, l_quantity::BIGINT AS sold, CASE WHEN l_linenumber % 4 <> 0 THEN floor(l_extendedprice) END AS price, CASE WHEN l_linenumber % 3 = 0 THEN floor(l_tax * 100) END AS shipping, l_linenumber AS score, l_shipdate::DATE::VARCHAR AS last_sold FROM lineitem),
  ev AS (SELECT find, run, sum(sold)::BIGINT AS units, {round_sql("(sum(price * sold) / sum(sold) FILTER (price IS NOT NULL))")} AS average_price, {round_sql("(sum(shipping * sold) / sum(sold) FILTER (shipping IS NOT NULL))")} AS average_shipping, {round_sql("(sum(score * sold)::DOUBLE / sum(sold)::DOUBLE)", 4)} AS match_score, max(sold) AS largest_row, max(last_sold) AS last_sold FROM rr GROUP BY 1, 2)"""


@query(f"""WITH {_EVIDENCE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY find ORDER BY units DESC, match_score DESC, run) AS n FROM ev) SELECT find, run, units, average_price, average_shipping, match_score, largest_row, last_sold FROM r WHERE n = 1""")
def research_evidence(spark, sf_dir):
    """Weighted evidence of every run of research rows, and the best run of each find."""
    line = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("find"), F.col("l_suppkey").alias("run"), F.col("l_quantity").cast("long").alias("sold"), F.when(line % 4 != 0, F.floor("l_extendedprice")).alias("price"), F.when(line % 3 == 0, F.floor(F.col("l_tax") * 100)).alias("shipping"), line.alias("score"), F.to_date("l_shipdate").cast("string").alias("last_sold"))
    return research.best_run(research.run_evidence(rows, ["find", "run"]), "find", "run")


@query("""WITH x AS (SELECT c_custkey AS find FROM customer), e AS (SELECT c_custkey AS find, c_nationkey AS entry FROM customer WHERE c_custkey % 3 = 0), f AS (SELECT c_custkey AS find, 100 + c_nationkey AS entry FROM customer WHERE c_custkey % 2 = 0)
  SELECT find, entry, 'exact' AS match FROM e UNION ALL SELECT find, entry, 'fuzzy' FROM f WHERE find NOT IN (SELECT find FROM e)""")
def exact_else_fuzzy(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("find"), "c_nationkey")
    return research.exact_else_fuzzy(c, c.where("find % 3 = 0").select("find", F.col("c_nationkey").alias("entry")), c.where("find % 2 = 0").select("find", (F.col("c_nationkey") + 100).alias("entry")), "find")


@query(f"""WITH {SOLD_SQL}, g AS (SELECT item, source, bool_and(gross <= 25 AND age IS NOT NULL) AND count(*) < 50 AND count(DISTINCT order_no) = count(*) AS sound, count(*) FILTER (age BETWEEN 0 AND 30) AS a, count(*) FILTER (age BETWEEN 0 AND 90) AS b, count(*) FILTER (age BETWEEN 0 AND 365) AS c FROM sold GROUP BY 1, 2)
  SELECT item, source, sound, CASE WHEN sound THEN a END AS units_30, CASE WHEN sound THEN b END AS units_90, CASE WHEN sound THEN c END AS units_365 FROM g""")
def dated_windows(spark, sf_dir):
    rows = sold_lines(spark, sf_dir).select("item", "source", F.when(F.col("gross") <= 25, 1).otherwise(2).alias("sold"), "age", F.col("order_no").alias("listing"))
    return research.dated_windows(rows, ["item", "source"])


@query("""WITH p AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS t, [lower(p_type)] AS a, string_split(p_name || ' ' || lower(p_type), ' ') AS l FROM part), q AS (SELECT x.id, y.id AS listing, x.t, x.a, y.l FROM p x JOIN p y ON y.id BETWEEN x.id + 1 AND x.id + 3),
  c AS (SELECT id, listing, len(list_filter(t, lambda w: list_contains(l, w))) AS hits, len(t) AS n, len(list_filter(a, lambda w: list_contains(l, w)))::DOUBLE / len(a) AS ac FROM q)
  SELECT id, listing, """ + round_sql("(hits::DOUBLE / n::DOUBLE * 0.65 + ac * 0.2 + 0.15)", 3) + """ AS score, hits >= CASE WHEN n <= 2 THEN n ELSE greatest(2, ceil(n * 0.6)) END AND ac >= 0.5 AND hits::DOUBLE / n >= 0.6 AND """ + round_sql("(hits::DOUBLE / n::DOUBLE * 0.65 + ac * 0.2 + 0.15)", 3) + """ >= 0.8 AS matched FROM c""")
def active_listing_match(spark, sf_dir):
    """Each part's name against the three next parts as listings."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("t"), F.array(F.lower("p_type")).alias("a"), F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ").alias("l"))
    pairs = p.select("id", "t", "a", F.explode(F.sequence(F.col("id") + 1, F.col("id") + 3)).alias("listing")).join(p.select(F.col("id").alias("listing"), "l"), "listing")
    none = F.array().cast("array<string>")
    out = research.listing_match(F.col("t"), F.col("a"), F.col("l"), none, none)
    return pairs.select("id", "listing", out["score"].alias("score"), out["matched"].alias("matched"))


@query(f"""WITH b AS (SELECT l_orderkey AS order_no, l_linenumber AS line_no, l_partkey AS item, l_suppkey AS source, l_extendedprice AS paid, {round_sql("l_extendedprice * l_discount")} AS fin, CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END AS ful, l_quantity AS q FROM lineitem),
  x AS (SELECT *, greatest(fin, ful) AS refund FROM b) SELECT order_no, line_no, item, source, {round_sql("refund")} AS refund_amount, CASE WHEN paid > 0 THEN {plain_sql("least(1.0, refund / paid)", 4)} ELSE 0 END AS refund_rate,
  (CASE WHEN fin >= paid * 0.95 OR (fin = 0 AND ful >= paid * 0.8) THEN 0 ELSE greatest(1, floor(q)) END)::BIGINT AS retained FROM x""")
def record_economics(spark, sf_dir):
    """Refund, refund rate and retained units of every sold line."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    b = l.select(F.col("l_orderkey").alias("order_no"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("source"), F.col("l_extendedprice").alias("paid"), money.round_half_up(F.col("l_extendedprice") * F.col("l_discount")).alias("fin"), F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0.0).alias("ful"), F.col("l_quantity").alias("q"))
    out = decisions.record_economics("paid", "fin", "ful", "q")
    return b.select("order_no", "line_no", "item", "source", *[c.alias(n) for n, c in out.items()])


@query("""SELECT event_type, CASE WHEN event_type = 'purchase' THEN 'shipping_label' WHEN event_type || ' fee' ILIKE '%error%' THEN 'selling_fee' ELSE 'other' END AS charge, count(*) AS n FROM events GROUP BY 1, 2""")
def charge_classes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "SHIPPING_LABEL").otherwise("NON_SALE_CHARGE")
    fee = F.when(F.col("event_type") == "error", "FINAL_VALUE_FEE").otherwise("")
    return e.groupBy("event_type", decisions.charge_class(kind, fee, F.lit("")).alias("charge")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SOLD_SQL}, p AS (SELECT item, source, order_no, CASE WHEN units = 0 THEN 1 ELSE 0 END AS gone, cents FROM sold),
  o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY gone, cents, order_no, source) AS r FROM p), k AS (SELECT item, source, cents FROM o WHERE r = 1), n AS (SELECT source, count(*) AS kept, min(cents) AS best FROM k GROUP BY source), a AS (SELECT source, count(*) AS seen FROM sold GROUP BY source)
  SELECT s_suppkey AS source, coalesce(seen, 0)::BIGINT AS seen, coalesce(kept, 0)::BIGINT AS kept, best FROM supplier LEFT JOIN a ON a.source = s_suppkey LEFT JOIN n ON n.source = s_suppkey""")
def source_yield(spark, sf_dir):
    """Per source: rows seen, rows that are some item's best offer, the cheapest of these; sources without any stay."""
    sold = sold_lines(spark, sf_dir)
    best = ranking.best_per_key(sold, ["item"], [F.when(F.col("units") == 0, 1).otherwise(0), F.col("cents"), F.col("order_no"), F.col("source")])
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"))
    seen, kept = sold.groupBy("source").agg(F.count(F.lit(1)).alias("seen")), best.groupBy("source").agg(F.count(F.lit(1)).alias("kept"), F.min("cents").alias("best"))
    return sources.join(seen, "source", "left").join(kept, "source", "left").select("source", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("kept", F.lit(0)).alias("kept"), "best")


@query("""WITH p AS (SELECT p_partkey AS id, p_retailprice / 40 * 1.2 AS was, p_retailprice / 40 AS price, p_retailprice / 30 AS sold, p_size FROM part) SELECT id, round(50 * 0.35 + least(20.0, floor((was - price) / was * 40 + 0.5)) + least(30.0, greatest(-20.0, floor((sold + 1 - price) * 1.5 + 0.5))) + CASE WHEN p_size > 0 THEN least(12.0, log2(1 + p_size) * 3) ELSE 0 END
  + CASE WHEN p_size >= 20 THEN 25 WHEN p_size >= 10 THEN 20 WHEN p_size >= 5 THEN 14 WHEN p_size >= 2 THEN 7 ELSE 0 END + CASE WHEN price <= 13 THEN 12 WHEN price <= 15 THEN 9 WHEN price <= 20 THEN 5 WHEN price > 35 THEN -15 WHEN price > 25 THEN -10 ELSE -5 END, 6) AS score FROM p""")
def quality_score(spark, sf_dir):
    """Rank score of every part as a candidate."""
    price = F.col("p_retailprice") / 40
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (price * 1.2).alias("was"), price.alias("price"), (F.col("p_retailprice") / 30).alias("sold"), F.lit(1.0).alias("ship"), "p_size")
    return rows.select("id", F.round(decisions.quality_score(F.lit(50.0), F.lit(0), "was", "price", "sold", "ship", "p_size", "p_size"), 6).alias("score"))



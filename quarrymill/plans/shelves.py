"""Pages with cards and headlines built from the supplied tables, with SQL of its own that states each outcome from the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import cards
from .adapters import spread, table
from .catalogue import query

SITE = r"(?i)^https?://(?:www\.)?drops\.example/deals/(?!type/)"


def _dollars(c):
    return F.format_string("$%d.%02d", F.floor(c / 100).cast("long"), F.pmod(c, F.lit(100)))


def _shop_pages(spark, sf_dir):
    """A page for each part: a list item around an article, a product link with its prices, or a sold-out article, by the part's size."""
    c = F.floor(F.col("p_retailprice") * 100 / 8).cast("long")
    less = F.when(F.col("p_size") % 2 == 1, F.floor(c * 95 / 100).cast("long")).otherwise(c)
    k, brand, name = F.col("p_partkey").cast("string"), F.col("p_brand"), F.col("p_name")
    slug = F.replace(name, F.lit(" "), F.lit("-"))
    menu = F.concat(F.lit('<ul><li class="menu"><a href="/c/'), k, F.lit('/vinyl">Vinyl under $9</a></li></ul>'))
    item = F.concat(
        F.lit('<li class="product" data-name="'), brand, F.lit(" - "), name, F.lit(" (Vinyl LP), "), _dollars(c), F.lit('" data-id="'), k, F.lit('"><article class="card" data-entity-id="'), k, F.lit('" data-product-price="'), F.replace(_dollars(less), F.lit("$"), F.lit("")),
        F.lit('"><a href="/music/vinyl/'), slug, F.lit("-"), k, F.lit('/#more" aria-label="'), name, F.lit('">more</a><div class="price">'), _dollars(c), F.lit("</div></article></li>"),
    )
    link = F.concat(
        F.lit('<a href="/p/'), k, F.lit("/"), slug, F.lit('" title="'), brand, F.lit("/"), name, F.lit('"><span class="see-more-format">'), F.lower("p_type"), F.lit('</span><span itemprop="price">'), F.replace(_dollars(less), F.lit("$"), F.lit("")),
        F.lit('</span><span class="sale-price">'), _dollars(less), F.lit('</span><s class="normal-price">'), _dollars(c + 100), F.lit("</s></a>"),
    )
    sold = F.concat(F.lit('<article class="big card"><img alt="'), brand, F.lit(" @ "), name, F.lit('" src="/i/'), k, F.lit('.jpg"><a href="/products/'), slug, F.lit("-"), k, F.lit('">'), name, F.lit("</a> Sold out, was "), _dollars(c), F.lit("</article>"))
    body = F.when(F.col("p_size") <= 20, item).when(F.col("p_size") <= 40, link).otherwise(sold)
    return spread(table(spark, sf_dir, "part")).select("p_partkey", F.concat(F.lit("https://shop"), (F.col("p_partkey") % 7).cast("string"), F.lit(".example/sale")).alias("url"), F.concat(menu, body).alias("html"))


@query("""WITH a AS (SELECT *, floor(p_retailprice * 100 / 8)::BIGINT AS c FROM part), b AS (SELECT *, CASE WHEN p_size % 2 = 1 THEN floor(c * 95 / 100)::BIGINT ELSE c END AS l, 'https://shop' || p_partkey % 7 || '.example' AS site, replace(p_name, ' ', '-') AS slug FROM a),
d AS (SELECT *, CASE WHEN p_size <= 20 THEN least(CASE WHEN c <= 25000 THEN c END, CASE WHEN l <= 25000 THEN l END) WHEN p_size <= 40 THEN CASE WHEN l <= 25000 THEN l END ELSE CASE WHEN c <= 25000 THEN c END END AS price FROM b)
SELECT p_partkey, 1 AS rank, CASE WHEN p_size <= 40 THEN 'product:' || p_partkey ELSE 'url:' || site || '/products/' || slug || '-' || p_partkey END AS stable_id, CASE WHEN p_size <= 40 THEN p_partkey::VARCHAR END AS product_id,
  CASE WHEN p_size <= 20 THEN CASE WHEN c <= 25000 THEN p_brand || ' - ' || p_name || ' (Vinyl LP)' ELSE p_name END WHEN p_size <= 40 THEN p_brand || ' - ' || p_name || CASE WHEN contains(lower(p_brand || ' - ' || p_name), lower(p_type)) THEN '' ELSE ' (' || lower(p_type) || ')' END ELSE p_brand || ' - ' || p_name END AS title,
  site || CASE WHEN p_size <= 20 THEN '/music/vinyl/' || slug || '-' || p_partkey || '/' WHEN p_size <= 40 THEN '/p/' || p_partkey || '/' || slug ELSE '/products/' || slug || '-' || p_partkey END AS url,
  price / 100.0::DOUBLE AS price, CASE WHEN p_size <= 20 THEN CASE WHEN c > price AND c <= 25000 THEN c END WHEN p_size <= 40 THEN CASE WHEN c + 100 <= 25000 THEN c + 100 END END / 100.0::DOUBLE AS regular,
  'USD' AS currency, CASE WHEN p_size > 40 THEN site || '/i/' || p_partkey || '.jpg' END AS image, CASE WHEN p_size > 40 THEN FALSE END AS available, CASE WHEN p_size > 40 THEN 'out_of_stock' ELSE 'unknown' END AS state,
  CASE WHEN p_size <= 20 AND c <= 25000 THEN 2 ELSE 1 END AS cards FROM d WHERE price IS NOT NULL""")
def product_cards(spark, sf_dir):
    return cards.product_cards(_shop_pages(spark, sf_dir), "p_partkey")


def _boards(spark, sf_dir):
    """A page for each brand and size, a forum's and a deal site's: its parts in order, each a headline, a flair and a gap as long as its key says."""
    k, c = F.col("p_partkey"), F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long")
    flair = F.when(k % 11 == 3, "Expired").otherwise("current")
    gap = F.repeat(F.lit("."), (k % 9 * 80).cast("int"))
    row = F.concat(
        F.lit('<a class="title may-blank" href="/go/'), k.cast("string"), F.lit('" data-permalink="/r/'), k.cast("string"), F.lit('/">['), F.col("p_type"), F.lit("] "), F.col("p_name"), F.lit(" &amp; more - "), _dollars(c), F.lit("</a><b>"), flair, F.lit("</b><p>"), gap, F.lit("</p>")
    )
    card = F.concat(F.lit('<a href="/deals/type/'), F.col("p_type"), F.lit('" class="card">all</a><a href="/deals/'), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit('" class="wide card"><h2 class="deal-title">'), F.col("p_name"), F.lit(" no. "), k.cast("string"), F.lit("</h2>$5</a>"))
    parts = table(spark, sf_dir, "part").groupBy(F.concat_ws("/", "p_brand", "p_size").alias("board")).agg(F.array_sort(F.collect_list(F.struct(k, row.alias("row"), card.alias("card")))).alias("_r"))
    return parts.select("board", F.array_join("_r.row", "").alias("forum"), F.array_join("_r.card", "").alias("deals"))


@query("""WITH a AS (SELECT *, p_brand || '/' || p_size AS board, '$' || (floor(p_retailprice * 100 + 0.5)::BIGINT // 100) || '.' || lpad((floor(p_retailprice * 100 + 0.5)::BIGINT % 100)::VARCHAR, 2, '0') AS shown, p_partkey % 11 = 3 AS flair FROM part),
b AS (SELECT *, length('<a class="title may-blank" href="/go/' || p_partkey || '" data-permalink="/r/' || p_partkey || '/">[' || p_type || '] ' || p_name || ' &amp; more - ' || shown || '</a>') AS size, row_number() OVER (PARTITION BY board ORDER BY p_partkey) AS n FROM a),
e AS (SELECT *, sum(size + 3 + 7 + 7 + 80 * (p_partkey % 9) + 4) OVER (PARTITION BY board ORDER BY n) - (size + 3 + 7 + 7 + 80 * (p_partkey % 9) + 4) AS pos FROM b), x AS (SELECT board, pos + size + 3 AS word FROM e WHERE flair)
SELECT board, n + count(*) FILTER (flair) OVER (PARTITION BY board ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS position, '[' || p_type || '] ' || p_name || ' & more - ' || shown AS title, 'https://forum.example/go/' || p_partkey AS direct_url,
  'https://forum.example/r/' || p_partkey || '/' AS discussion_url, regexp_extract(shown, '[$]([0-9]{1,3}([.][0-9]{2})?)', 1)::DOUBLE AS price, EXISTS (SELECT 1 FROM x WHERE x.board = e.board AND word >= pos - 500 AND word + 7 <= pos + size + 700) AS expired FROM e""")
def forum_rows(spark, sf_dir):
    pages = _boards(spark, sf_dir).select("board", F.lit("https://forum.example/r/new/").alias("url"), F.col("forum").alias("html"))
    return cards.forum_rows(pages, "board")


@query("""WITH a AS (SELECT *, p_brand || '/' || p_size AS board, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS n FROM part)
SELECT board, 'https://drops.example/deals/' || replace(p_name, ' ', '-') AS detail_url, 2 * min(n) - 1 AS position, arg_min(p_name || ' no. ' || p_partkey, n) AS title FROM a GROUP BY board, p_name""")
def deal_cards(spark, sf_dir):
    pages = _boards(spark, sf_dir).select("board", F.lit("https://drops.example/deals").alias("url"), F.col("deals").alias("html"))
    return cards.deal_cards(pages, "board", SITE)

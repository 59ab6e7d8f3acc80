"""Rows out of raw pages, by regular expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import col, let
from ..functions.urls import host

ANCHOR = r"(?is)<a\s[^>]*href=[\"']([^\"'>]+)[\"'][^>]*>(.{0,500}?)</a>"
# Named entities that occur in shop pages.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&ndash;": "–", "&mdash;": "—", "&rsquo;": "’", "&lsquo;": "‘", "&ldquo;": "“", "&rdquo;": "”", "&amp;": "&"}
# What may stand between a word and an amount, the words that make an amount before them or after them no price.
_GAP = r"[\s:-]{0,4}(?:&nbsp;|<[^<>]{0,300}>)?" * 4 + r"[\s:-]{0,4}"
NOT_AFTER = rf"\b(?:delivery|shipping|save|savings|coupon|gift card|spend|orders?\s{{1,4}}over|(?:shipping|delivery)\s{{1,4}}(?:on|over)){_GAP}"
NOT_BEFORE = rf"{_GAP}(?:(?:delivery|shipping|coupon|gift card|off\s+(?:coupon|orders?))\b|(?:/\s*|per\s+)(?:ea(?:ch)?|unit|item|lb|oz|fl\.?\s*oz|kg|g|100g|ct|count)\b)"
# One amount: its context is looked at and not consumed, its digits are never given back.
AMOUNT = rf"(?is)(?:\$|\bUSD\b)(?<!{NOT_AFTER}(?:\$|USD))\s*+(\d[\d,]*+(?:\.\d{{2}})?+)(?!{NOT_BEFORE})"


def numeric_entities(text) -> Column:
    """&#38; and &#x26; as their characters; numbers that name none stay."""
    t = col(text)
    pieces = F.regexp_extract_all(t, F.lit(r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});|[^&]++|&"), F.lit(0))

    def shown(x):
        digits = F.regexp_extract(x, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
        code = F.when(F.lower(F.substring(x, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        known = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        return F.when(known & x.startswith("&#"), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(x)

    return F.when(t.contains("&#"), F.array_join(F.transform(pieces, shown), "")).otherwise(t)


def decode_entities(text) -> Column:
    """Numeric and named entities, twice, so that doubly escaped ones come out too. Most texts hold none."""

    def decoded(out):
        for _ in range(2):
            out = let(out, numeric_entities)
            for name, char in ENTITIES.items():
                out = F.replace(out, F.lit(name), F.lit(char))
        return out

    return let(col(text), lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t))


def plain_text(html) -> Column:
    """Text of a fragment: no scripts, styles or tags, entities decoded, white space folded."""
    bare = F.regexp_replace(F.regexp_replace(col(html), r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(decode_entities(bare), r"\s+", " "))


def anchors(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, position, href and text of every anchor of a page."""
    whole = F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(0))
    return pages.select(key, F.posexplode(whole).alias("position", "_a")).select(key, "position", F.regexp_extract("_a", ANCHOR, 1).alias("href"), plain_text(F.regexp_extract("_a", ANCHOR, 2)).alias("text"))


def prices(text) -> Column:
    """Dollar amounts of a text, each judged alone: none that a word about shipping, coupons or savings stands right before, or one about shipping, coupons or units right after."""
    amounts = F.regexp_extract_all(col(text), F.lit(AMOUNT), F.lit(1))
    return F.transform(amounts, lambda a: F.replace(a, F.lit(","), F.lit("")).try_cast("double"))


def scored_links(pages: DataFrame, key: str, url: str, rules: list[tuple[str, str, int]], least: int, k: int) -> DataFrame:
    """The k best links of the page's own host. rules: (column "href" or "text", pattern, points); the best score of each address counts."""
    links = anchors(pages, key).join(pages.select(key, F.col(url).alias("_page")), key)
    links = links.where(F.col("href").startswith("/") | (host("href") == host("_page")))
    score = sum((F.when(F.col(c).rlike(p), points).otherwise(0) for c, p, points in rules), F.lit(0))
    best = links.withColumn("score", score).groupBy(key, "href").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "href"))).where(F.col("rank") <= k)


# What marks a link to the next page of a listing and a link to a sale.
PAGINATION = [("href", r"(?i)[?&]page=\d+", 25), ("href", r"(?i)/page/\d+", 20), ("text", r"(?i)^\s*(next|more|›|»|>)\s*$", 80)]
SALES = [("text", r"(?i)\b(sale|clearance|closeout|deals?)\b", 60), ("href", r"(?i)(sale|clearance|closeout|deal)", 40)]


def json_ld(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, position and variant of every node of ld+json scripts: top-level, @graph members and list items, two levels deep. Broken scripts give none."""
    script = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
    bodies = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(script), F.lit(1))).alias("position", "_b"))
    tops = bodies.select(key, "position", F.try_parse_json(F.trim("_b")).alias("node")).where("node is not null")
    as_list = lambda path: F.try_variant_get("node", path, "array<variant>")
    level = tops.select(key, "position", F.explode(F.coalesce(as_list("$"), F.array("node"))).alias("node"))
    out = level
    for _ in range(2):
        graph = level.select(key, "position", F.explode(as_list("$['@graph']")).alias("node"))
        items = level.select(key, "position", F.explode(as_list("$.itemListElement")).alias("_i")).select(key, "position", F.coalesce(F.try_variant_get("_i", "$.item", "variant"), F.col("_i")).alias("node"))
        level = graph.unionByName(items)
        out = out.unionByName(level)
    return out


def json_ld_products(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Products of ld+json nodes: name, sku, gtin, price of the first offer that isn't out of stock."""
    get = lambda path, kind="string": F.try_variant_get("node", path, kind)
    nodes = json_ld(pages, key, html).where(F.coalesce(get("$['@type']"), F.lit("")) == "Product")
    offers = F.coalesce(get("$.offers", "array<struct<price: string, lowPrice: string, availability: string>>"), F.array(get("$.offers", "struct<price: string, lowPrice: string, availability: string>")))
    usable = F.filter(offers, lambda o: o.isNotNull() & ~F.coalesce(o["availability"].rlike("(?i)out.?of.?stock|sold.?out"), F.lit(False)))
    rows = nodes.select(key, "position", get("$.name").alias("title"), get("$.sku").alias("sku"), F.coalesce(get("$.gtin13"), get("$.gtin")).alias("gtin"), F.get(usable, F.lit(0)).alias("_o"), get("$.offers", "variant").isNotNull().alias("_has"), get("$.price").alias("_p"))
    return rows.where(~F.col("_has") | F.col("_o").isNotNull()).select(key, "position", "title", "sku", "gtin", F.coalesce("_o.price", "_o.lowPrice", "_p").try_cast("double").alias("price"))

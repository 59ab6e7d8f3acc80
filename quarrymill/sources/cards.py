"""Product cards of shop pages, rows of forum pages and cards of deal pages, by regular expressions inside the JVM.

All three take one row a page; key names the page. Null and empty pages give no rows. Lengths and distances count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import col, computed, let
from ..functions.urls import absolute
from .html import decode_entities, plain_text

# What a card is, how a product's path begins, the longest card and the longest link that is one.
PRODUCT_PATH = r"(?i)/(?:music/vinyl|p|product|products|release|releases)/"
CARDS = [
    r"(?i)<li\b[^>]*class=[\"'][^\"']*\bproduct\b[^\"']*[\"'][^>]*>[\s\S]{0,12000}?</li>",
    r"(?i)<article\b[^>]*class=[\"'][^\"']*\bcard\b[^\"']*[\"'][^>]*>[\s\S]{0,12000}?</article>",
    r"(?i)<a\b[^>]*href=[\"'][^\"']*/p/[^\"']+[\"'][^>]*>[\s\S]{0,6000}?</a>",
]
# The lowest and highest price of a card, the words that make it sold out, classes of prices.
LOWEST, HIGHEST = 2.0, 250.0
SOLD_OUT = r"(?i)\b(?:discontinued|out\s+of\s+stock|sold\s+out|unavailable)\b"
WAS = ["normal-price", "price--rrp", "price--non-sale", "price-was"]
MONEY = r"\$[\s ]*([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?)"
# A price in a headline, and how far around a link a word about its expiry counts.
HEADLINE_PRICE = r"\$\s*([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?|[0-9]+(?:\.[0-9]{2})?)"
BEFORE, AFTER = 500, 700
LINK = r"(?is)<a\b([^>]*)>(.*?)</a>"


def attribute(tag, name: str) -> Column:
    """Value of a tag's attribute, entities decoded; empty where it has none."""
    found = F.regexp_extract(col(tag), rf"(?i)(?:^|\s){name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    return decode_entities(F.regexp_replace(found, r"^([\"'])(.*)\1$", "$2"))


def _address(href, page) -> Column:
    return let(F.regexp_replace(F.replace(F.trim(col(href)), F.lit(" "), F.lit("%20")), r"#.*$", ""), lambda h: absolute(h, page))


def _path(url) -> Column:
    return F.regexp_extract(col(url), r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)


def _of_class(name: str, most: int) -> str:
    return rf"(?i)<[^>]*class=[\"'][^\"']*\b{name}\b[^\"']*[\"'][^>]*>([\s\S]{{0,{most}}}?)</[^>]+>"


def _usable(prices) -> Column:
    return F.filter(prices, lambda p: p.isNotNull() & p.between(LOWEST, HIGHEST))


def _amounts(fragments) -> Column:
    """Usable dollar amounts of all fragments of an array, tags aside."""
    bare = lambda f: F.regexp_replace(F.regexp_replace(F.regexp_replace(f, r"(?is)<(script|style)\b.*?</\1>|<[^>]+>", " "), r"(?i)&#0*36;|&#x0*24;", r"\$"), r"(?i)&nbsp;|&#160;|&#xa0;", " ")
    found = F.flatten(F.transform(fragments, lambda f: F.regexp_extract_all(bare(f), F.lit(MONEY), F.lit(1))))
    return _usable(F.transform(found, lambda a: F.replace(a, F.lit(","), F.lit("")).try_cast("double")))


def _number(text) -> Column:
    return F.regexp_replace(text, r"[$,\s]", "").try_cast("double")


def _title(block: str, opening: Column, link: Column, inner: Column) -> Column:
    """A card's title: a name it states, else artist and release, else its heading, its picture's text or the link's, and the format where the title lacks it."""
    first = lambda name: F.regexp_extract(block, _of_class(name, 600), 1)
    parts = F.array(
        attribute(opening, "data-name"), attribute(link, "title"), attribute(link, "aria-label"), first("product-title"), first("product-artist"),
        first("card-title"), F.regexp_extract(block, r"(?i)<img\b[^>]*\balt=[\"']([^\"']+)[\"']", 1), inner, first("see-more-format"),
    )

    def chosen(p):
        at = lambda i: F.nullif(F.get(p, F.lit(i)), F.lit(""))
        title = F.coalesce(at(0), at(1), at(2), F.concat(at(3), F.lit(" - "), at(4)), at(5), at(6), at(7), F.lit(""))
        # A price at the end goes; a slash or an at sign between artist and release is a dash.
        for pattern, to in ((r"\s*,?\s*\$\s*[0-9][0-9,.]*\s*$", ""), (r"^(.{2,100}?)/([^/].+)$", "$1 - $2"), (r"\s*@\s*", " - "), (r"\s+", " ")):
            title = F.regexp_replace(title, pattern, to)
        lacks = lambda t: at(8).isNotNull() & ~F.contains(F.lower(t), F.lower(at(8)))
        return let(title, lambda t: F.when(lacks(t), F.concat(F.trim(t), F.lit(" ("), at(8), F.lit(")"))).otherwise(F.trim(t)))

    return let(F.transform(parts, plain_text), chosen)


def _blocks(html: str) -> Column:
    """Everything on a page that may be a product card: list items, articles and product links, in this order."""
    return F.concat(*(F.regexp_extract_all(F.col(html), F.lit(p), F.lit(0)) for p in CARDS))


def product_cards(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """Products of a page's cards: key, rank (from 1, by first place), stable_id, product_id, title, url, price, regular, currency, image, available, state and cards (how many gave it).

    A card needs a link to a product, a title of 3 to 300 characters and a price of 2 to 250 dollars. Cards with one product id, or else one
    address, are one product: least price, greatest regular price, longest title (the first of equal ones), address and picture of the first that has one,
    sold out if one says so, with the state of the last."""
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_page"), F.posexplode(_blocks(html)).alias("_place", "_block"))
    # What follows reads these columns many times, filters included: each step's are computed once and kept.
    told = lambda a: F.struct(F.regexp_extract(a, LINK, 1).alias("tag"), F.regexp_extract(a, LINK, 2).alias("inner"))
    link = lambda x: F.struct(x["tag"].alias("tag"), x["inner"].alias("inner"), _address(attribute(x["tag"], "href"), F.col("_page")).alias("url"))
    links = F.transform(F.transform(F.regexp_extract_all("_block", F.lit(LINK), F.lit(0)), told), link)
    leads = F.filter(links, lambda x: _path(x["url"]).rlike(PRODUCT_PATH))
    rows = computed(rows, {"_opening": F.regexp_extract("_block", r"^<[^>]+>", 0), "_link": F.get(leads, F.lit(0))}).where("_link IS NOT NULL")
    opening, tag, url_of = F.col("_opening"), F.col("_link.tag"), F.col("_link.url")
    named = [F.trim(attribute(t, name)) for t, name in ((opening, "data-product-id"), (opening, "data-entity-id"), (opening, "data-id"), (tag, "data-product-id"))]
    stated_ids = F.filter(F.array(*named, F.regexp_extract(_path(url_of), r"(?i)/p/(\d+)(?:/|$)", 1)), lambda n: n != "")
    identity = let(F.get(stated_ids, F.lit(0)), lambda n: F.when(F.length(n) <= 160, n))
    of_class = lambda names: F.flatten(F.array(*(F.regexp_extract_all("_block", F.lit(_of_class(n, 300)), F.lit(1)) for n in names)))
    stated = F.array(_number(attribute(opening, "data-product-price")), _number(attribute(tag, "data-product-price")))
    marked = F.transform(F.regexp_extract_all("_block", F.lit(r"(?i)<[^>]*itemprop=[\"']price[\"'][^>]*>([\s\S]{0,80}?)</"), F.lit(1)), lambda t: _number(F.regexp_replace(t, r"<[^>]+>", " ")))
    image = decode_entities(F.regexp_extract("_block", r"(?i)<img\b[^>]*(?:data-src|src)=[\"']([^\"']+)[\"']", 1))
    picture = let(image, lambda i: F.when(i.startswith("//"), F.concat(F.lit("https:"), i)).otherwise(F.nullif(i, F.lit(""))))
    rows = computed(
        rows.select("_key", "_place", "_page", "_block", "_opening", "_link"),
        {
            "_url": url_of, "_id": identity, "_title": _title("_block", opening, tag, F.col("_link.inner")), "_sold": plain_text("_block").rlike(SOLD_OUT), "_sale": F.concat(_usable(F.concat(stated, marked)), _amounts(of_class(["sale-price"]))),
            "_seen": _amounts(F.concat(of_class(["price"]), F.array("_block"))), "_was": _amounts(of_class(WAS)), "_currency": F.when(F.contains("_block", F.lit("$")), "USD"), "_image": _address(picture, F.col("_page")),
        },
    ).drop("_page", "_block", "_opening", "_link")
    rows = computed(rows, {"_price": F.array_min(F.concat("_sale", "_seen"))}).where("_price IS NOT NULL AND length(_title) BETWEEN 3 AND 300")
    rows = rows.withColumn("_regular", F.array_max(F.filter(F.concat("_was", "_seen"), lambda p: p > F.col("_price"))))
    same = F.coalesce(F.concat(F.lit("id:"), "_id"), F.concat(F.lit("url:"), F.lower("_url")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_place")))
    found = rows.groupBy("_key", same.alias("_same")).agg(
        F.min("_place").alias("_place"), first("_id").alias("product_id"), F.min_by("_title", F.struct(-F.length("_title"), "_place")).alias("title"), first("_url").alias("url"), F.min("_price").alias("price"), F.max("_regular").alias("regular"),
        F.max_by("_currency", "_place").alias("currency"), first("_image").alias("image"), F.bool_or("_sold").alias("_any"), F.max_by("_sold", "_place").alias("_last"), F.count(F.lit(1)).alias("cards"),
    )
    stable = F.coalesce(F.concat(F.lit("product:"), F.lower("product_id")), F.concat(F.lit("url:"), F.lower("url")))
    rank = F.row_number().over(Window.partitionBy("_key").orderBy("_place"))
    return found.select(F.col("_key").alias(key), rank.alias("rank"), stable.alias("stable_id"), "product_id", "title", "url", "price", "regular", "currency", "image", F.when(F.col("_any"), False).alias("available"), F.when(F.col("_last"), "out_of_stock").otherwise("unknown").alias("state"), "cards")


def headline_price(title) -> Column:
    """First positive dollar amount of a headline."""
    amounts = F.transform(F.regexp_extract_all(col(title), F.lit(HEADLINE_PRICE), F.lit(1)), lambda a: F.replace(a, F.lit(","), F.lit("")).try_cast("double"))
    return F.get(F.filter(amounts, lambda p: p > 0), F.lit(0))


def forum_rows(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """Headlines of a forum page, the links of class "title": key, position (among the page's links and words about expiry), title, direct_url, discussion_url, price, expired.

    Expired: the word stands whole in the link, in the 500 characters before it or in the 700 after it. A page is cut into links and such words in one
    pass; where each begins follows from the lengths before it, so no row carries the page."""
    piece = r"(?is)\G(.*?)(<a\b[^>]*>.*?</a>|\bexpired\b)"
    gaps, marks = (F.regexp_extract_all(F.col(html), F.lit(piece), F.lit(g)) for g in (1, 2))
    pieces = F.arrays_zip(gaps.alias("gap"), marks.alias("mark"))
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_page"), F.posexplode(F.transform(pieces, lambda p: F.struct(F.length(p["gap"]).alias("gap"), p["mark"].alias("mark")))).alias("_at", "_p"))
    rows = rows.select("_key", "_page", "_at", F.col("_p.gap").alias("_gap"), F.col("_p.mark").alias("_mark"), F.length("_p.mark").alias("_size"))
    # How far into its piece the first and the last such word begin.
    lead, tail = F.regexp_extract("_mark", r"(?is)^(.*?)\bexpired\b", 1), F.regexp_extract("_mark", r"(?is)^(.*)\bexpired\b", 1)
    holds = F.col("_mark").rlike(r"(?i)\bexpired\b")
    is_title = attribute(F.regexp_extract("_mark", LINK, 1), "class").rlike(r"(?i)(?:^|\s)title(?:\s|$)")
    rows = rows.select("_key", "_page", "_at", "_gap", "_size", F.when(holds, F.length(lead)).alias("_first"), F.when(holds, F.length(tail)).alias("_last"), F.when(is_title, F.col("_mark")).alias("_mark"))
    order = Window.partitionBy("_key").orderBy("_at")
    rows = rows.withColumn("_start", F.sum(F.col("_gap") + F.col("_size")).over(order) - F.col("_size"))
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.select("*", F.max(F.col("_start") + F.col("_last")).over(earlier).alias("_before"), F.min(F.col("_start") + F.col("_first")).over(later).alias("_after")).where("_mark IS NOT NULL")
    near = F.col("_first").isNotNull() | F.coalesce(F.col("_before") >= F.col("_start") - BEFORE, F.lit(False)) | F.coalesce(F.col("_after") + len("expired") <= F.col("_start") + F.col("_size") + AFTER, F.lit(False))
    tag = F.regexp_extract("_mark", LINK, 1)
    rows = rows.select("_key", "_at", "_page", tag.alias("_tag"), plain_text(F.regexp_extract("_mark", LINK, 2)).alias("title"), near.alias("expired")).where("title <> ''")
    return rows.select(F.col("_key").alias(key), F.col("_at").alias("position"), "title", _address(attribute("_tag", "href"), F.col("_page")).alias("direct_url"), _address(attribute("_tag", "data-permalink"), F.col("_page")).alias("discussion_url"), headline_price("title").alias("price"), "expired")


def deal_cards(pages: DataFrame, key: str, site: str, url: str = "url", html: str = "html") -> DataFrame:
    """Cards of a deal page, the links of class "card" whose address matches site: key, position, detail_url, title. Of links to one address the first counts."""
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_page"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(0))).alias("_at", "_link"))
    rows = rows.select("_key", "_page", "_at", F.regexp_extract("_link", LINK, 1).alias("_tag"), F.regexp_extract("_link", LINK, 2).alias("_inner"))
    rows = rows.where(attribute("_tag", "class").rlike(r"(?i)(?:^|\s)card(?:\s|$)"))
    heading = r"(?is)<h[1-6]\b[^>]*class=[\"'][^\"']*title[^\"']*[\"'][^>]*>(.*?)</h[1-6]>"
    text = F.when(F.col("_inner").rlike(heading), F.regexp_extract("_inner", heading, 1)).otherwise(F.col("_inner"))
    rows = rows.select("_key", "_at", _address(attribute("_tag", "href"), F.col("_page")).alias("detail_url"), plain_text(text).alias("title"))
    rows = rows.where(F.col("detail_url").rlike(site) & (F.col("title") != ""))
    return rows.groupBy(F.col("_key").alias(key), "detail_url").agg(F.min("_at").alias("position"), F.min_by("title", "_at").alias("title"))

"""Products out of the JSON that shop pages carry: payloads, the walk of all their nodes, products with evidence, one row a product.

A page's payloads are its JSON scripts and what it assigns to `__NEXT_DATA__`. `leaves` goes down VARIANT values level by
level until nothing is left, whatever the depth: a level is one pass over the values of the level before, stored in the
shared folder. `products` reads off the objects that name a product and say something about buying it, `merged` joins
those of a page that share any identity.

Cases: null and empty pages and broken JSON give no rows; equal scripts of a page count once; null keys are rows like any
other. A price, state or identifier may be the
member of an object; offers may be listed in offers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import col, let, round_half_up
from ..functions.urls import absolute, without_tracking
from ..operators.matching import transitive_groups
from ..operators.storage import stored
from .html import decode_entities, plain_text

# Where products keep their parts, in the order in which they are looked up.
TITLES = ["title", "name", "productTitle", "product_title", "product_name"]
ADDRESSES = ["canonical", "canonicalUrl", "canonicalURL", "canonical_url", "productUrl", "productURL", "product_url", "productPageUrl", "product_page_url", "productHref", "pdpUrl", "pdpURL", "pdp_url", "buyUrl", "buy_url", "url"]
SKUS = ["sku", "SKU", "productSku", "product_sku", "merchantSku"]
UPCS = ["upc", "UPC", "barcode"]
GTINS = ["gtin14", "gtin13", "gtin12", "gtin8", "gtin"]
PRODUCT_IDS = ["productId", "productID", "product_id", "itemId", "itemID", "item_id", "usItemId"]
TCINS = ["tcin", "TCIN"]
PRICES = ["currentPrice", "current_price", "priceInfo.currentPrice", "priceInfo.salePrice", "priceData.currentPrice", "priceData.salePrice", "pricing.currentPrice", "pricing.current", "pricing.salePrice", "salePrice", "sale_price", "offerPrice", "offer_price", "lowPrice"]
REGULAR_PRICES = ["regularPrice", "regular_price", "priceInfo.regularPrice", "priceInfo.wasPrice", "priceInfo.comparisonPrice", "priceInfo.listPrice", "priceData.regularPrice", "priceData.originalPrice", "priceData.listPrice", "pricing.regularPrice", "pricing.originalPrice", "pricing.listPrice", "originalPrice", "original_price", "listPrice", "list_price", "wasPrice", "was_price", "compareAtPrice", "compare_at_price", "comparisonPrice", "strikeThroughPrice", "msrp"]
STATES = ["availability", "availabilityStatus", "availability_status", "availabilityStatusDisplayValue", "availabilityStatusV2", "stockStatus", "stock_status", "stock", "inventoryStatus", "inventory_status", "isInStock", "inStock", "isAvailable", "available"]
IMAGES = ["imageUrl", "imageURL", "image_url", "primaryImageUrl", "primary_image_url", "thumbnailUrl", "thumbnail_url", "primaryImage", "thumbnail", "image", "images"]
CURRENCIES = ["priceCurrency", "currency", "currencyCode", "priceInfo.currency", "priceInfo.currencyUnit", "priceInfo.currentPrice.currency", "priceInfo.currentPrice.currencyUnit"]
IN_PRICE = ["price", "value", "amount", "currentPrice", "salePrice", "displayValue", "priceString", "formattedPrice", "displayPrice", "minPrice"]
IN_STATE = ["value", "displayValue", "status", "availability", "availabilityStatus", "label", "text"]
IN_IMAGE = ["url", "contentUrl", "imageUrl", "imageURL", "src", "thumbnailUrl", "thumbnail"]
IN_ADDRESS = ["url", "href", "canonical", "canonicalUrl", "value"]
OFFER_SIGNS = ["price", "lowPrice", "highPrice", "currentPrice", "availability", "priceCurrency", "priceSpecification"]
OFFER_LISTS = ["offers", "items", "offer", "sellerOffers"]
OFFER_PRICES = ["currentPrice", "salePrice", "lowPrice", "price"]
OFFER_REGULAR_PRICES = ["regularPrice", "originalPrice", "listPrice", "highPrice", "wasPrice", "compareAtPrice", "priceSpecification.regularPrice", "priceSpecification.listPrice"]
OFFER_STATES = ["availability", "availabilityStatus", "inStock", "available"]
PRODUCT_TYPES = ["product", "productgroup", "productmodel"]
OTHER_TYPES = ["article", "breadcrumblist", "collectionpage", "event", "imageobject", "listitem", "offer", "organization", "person", "searchresultspage", "service", "webpage", "website"]
NOISE_PATHS = ["breadcrumb", "breadcrumbs", "facet", "facets", "filter", "filters", "footer", "header", "menu", "navigation", "seo"]
NOISE_TITLE = r"^(?:account|cart|checkout|contact us|continue shopping|customer service|help|home|loading|log in|login|menu|my account|order history|privacy policy|search|shop now|sign in|sign up|terms(?: and conditions)?|view details)$"
NO_PRODUCT_PATH = r"(?i)(?:\.(?:avif|gif|jpe?g|png|svg|webp)$|^/*$|^/(?:account|cart|checkout|contact|help|login|privacy|search|signin|terms)(?:/|$))"
STATE_RULES = [
    (r"\b(?:out of stock|outofstock|sold out|unavailable|discontinued|not available)\b", "out_of_stock"),
    (r"\b(?:limited stock|low stock|few left|only \d+ left)\b", "limited_stock"),
    (r"\b(?:pre ?order|preorder)\b", "preorder"),
    (r"\b(?:back ?order|backorder)\b", "backorder"),
    (r"\b(?:in stock|instock|available)\b", "in_stock"),
]
STATE_ORDER = ["unknown", "out_of_stock", "backorder", "preorder", "limited_stock", "in_stock"]
LIKE_A_RECORD = r"(?i)\b(?:vinyl|record|album|lp|edition|color|colour)\b"


# ---- payloads ----------------------------------------------------------------------------------------


def balanced(text) -> Column:
    """The JSON object or list that a text begins with, up to the bracket that closes it; null where none does.

    The text is cut into strings, brackets and what is between; one fold over these keeps the depth and the length so far."""
    t = col(text)
    opening = F.substring(t, 1, 1)
    closing = F.when(opening == "{", "}").otherwise("]")
    tokens = F.regexp_extract_all(t, F.lit(r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|[\[\]{}]|[^"\[\]{}]++|"'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("done"))

    def step(a, x):
        depth = a["depth"] + F.when(x == opening, 1).when(x == closing, -1).otherwise(0)
        return F.when(a["done"], a).otherwise(F.struct(depth.alias("depth"), (a["length"] + F.length(x)).alias("length"), (depth == 0).alias("done")))

    return F.when(opening.isin("{", "["), let(F.aggregate(tokens, start, step), lambda end: F.when(end["done"], F.substring(t, F.lit(1), end["length"]))))


def parsed(body) -> Column:
    """A VARIANT of JSON text that is an object or a list, as it stands or with its entities decoded; null where it is broken."""
    return let(F.trim(col(body)), lambda t: F.when(t.rlike(r"^[\[{]"), F.coalesce(F.try_parse_json(t), F.try_parse_json(decode_entities(t)))))


def payloads(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, position, kind (next_data, json_ld, application_json) and payload of every JSON payload of a page, scripts first."""
    script = r"(?is)<script\b([^>]*)>(.*?)</script>"
    attribute = lambda s, name: F.regexp_extract(F.regexp_extract(s, script, 1), rf"(?i)(?:^|\s){name}\s*=\s*[\"']?([^\"'\s>]*)", 1)
    kind = lambda s: (
        F.when(F.lower(attribute(s, "id")) == "__next_data__", "next_data")
        .when(F.lower(F.substring_index(attribute(s, "type"), ";", 1)) == "application/ld+json", "json_ld")
        .when(F.lower(F.substring_index(attribute(s, "type"), ";", 1)).rlike(r"^application/(?:json|[^;\s]+\+json)$"), "application_json")
    )
    body = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(s, script, 2)), r"^(?:<!--)?(?:<!\[CDATA\[)?", ""), r"(?:\]\]>)?(?:-->)?$", ""))
    one = lambda k, b: F.struct(k.alias("kind"), b.alias("body"))
    scripts = F.transform(F.regexp_extract_all(F.col(html), F.lit(script), F.lit(0)), lambda s: one(kind(s), body(s)))
    # What follows each assignment, from its first bracket on.
    assigned = F.slice(F.split(F.col(html), r"(?:(?:window|self|globalThis)\s*\.\s*)?__NEXT_DATA__\s*="), 2, 1 << 30)
    assigned = F.transform(assigned, lambda s: one(F.lit("next_data"), let(F.regexp_extract(s, r"(?s)[\[{].*", 0), balanced)))
    each = pages.select(key, F.posexplode(F.concat(scripts, assigned)).alias("position", "p")).where("p.kind IS NOT NULL AND p.body <> ''")
    each = each.withColumn("_n", F.row_number().over(Window.partitionBy(key, "p.body").orderBy("position"))).where("_n = 1")
    return each.select(key, "position", "p.kind", parsed("p.body").alias("payload")).where("payload IS NOT NULL")


# ---- the walk ----------------------------------------------------------------------------------------


def leaves(found: DataFrame, key: str, node: str = "payload") -> DataFrame:
    """key, position, kind, path, place and value of every scalar at any depth of VARIANT values. path: member names, * for a list's elements; place: where it stands among its kind, level by level.

    One pass a level, each over what the one before left: objects and lists."""
    spark = found.sparkSession
    here = found.select(key, "position", "kind", F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("place"), F.col(node).alias("node"))
    out, deeper = None, (F.try_variant_get("node", "$", "map<string,variant>").isNotNull()) | F.try_variant_get("node", "$", "array<variant>").isNotNull()
    while True:
        inside = here.lateralJoin(spark.tvf.variant_explode(F.col("node").outer()).alias("e"))
        inside = inside.select(key, "position", "kind", F.array_append("path", F.coalesce("e.key", F.lit("*"))).alias("path"), F.array_append("place", F.col("e.pos")).alias("place"), F.col("e.value").alias("node"))
        inside = stored(inside.withColumn("deeper", deeper), "payload-level")
        level = inside.where(~F.col("deeper")).select(key, "position", "kind", "path", "place", F.try_variant_get("node", "$", "string").alias("value")).where("value IS NOT NULL")
        out = level if out is None else out.unionByName(level)
        here = inside.where("deeper")
        if here.isEmpty():
            return out


# ---- products ----------------------------------------------------------------------------------------


def _rules() -> list[tuple[str, str, int, int]]:
    """(relative path, field, rank, parts of the path that name an offer): which leaf below a node gives which part of a product, the least rank first."""
    out = []

    def add(field: str, names: list[str], inner: list[str], base: str = ""):
        for i, name in enumerate(names):
            for j, more in enumerate(["", *(f".{n}" for n in inner)]):
                for star in ("", ".*") if field == "image" else ("",):
                    out.append((f"{base}{name}{star}{more}", field, 100 * i + j, base.count(".")))

    for field, names, inner in (("title", TITLES, []), ("type", ["@type", "@type.*"], []), ("url", ADDRESSES, IN_ADDRESS), ("sku", SKUS, IN_STATE), ("upc", UPCS, IN_STATE), ("gtin", GTINS, IN_STATE), ("product_id", PRODUCT_IDS, IN_STATE), ("tcin", TCINS, IN_STATE), ("price", PRICES, IN_PRICE), ("last_price", ["price"], IN_PRICE), ("regular", REGULAR_PRICES, IN_PRICE), ("state", STATES, IN_STATE), ("image", IMAGES, IN_IMAGE), ("currency", CURRENCIES, [])):
        add(field, names, inner)
    first = ["offers.", "offers.*."]
    for base in [*first, *(f"{b}{n}.{star}" for b in first for n in OFFER_LISTS for star in ("", "*."))]:
        for field, names, inner in (("offer_price", OFFER_PRICES, IN_PRICE), ("offer_regular", OFFER_REGULAR_PRICES, IN_PRICE), ("offer_state", OFFER_STATES, IN_STATE), ("offer_currency", ["priceCurrency", "currency"], [])):
            add(field, names, inner, base)
    return out


def _amount(text: Column) -> Column:
    number = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when((number > 0) & ~(text.contains("%") & ~text.rlike("[$€£¥]")), round_half_up(number))


def state_of(text) -> Column:
    """Availability that a text, or true or false, speaks of."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"https?://schema\.org/", ""), r"[_-]+", " "), r"\s+", " "))
    out = F.when(t == "true", "in_stock").when(t == "false", "out_of_stock")
    for pattern, name in STATE_RULES:
        out = out.when(t.rlike(pattern), name)
    return out.otherwise("unknown")


def products(found: DataFrame, key: str, page_url: str) -> DataFrame:
    """A row for each object that is a product: key, position, kind, place and its parts. found: `leaves`, page_url: a column of the key's.

    Every leaf looks at the objects up to six levels above it: a broadcast table of rules (fixed, some thousand rows) says
    what it is to each, and one aggregation by object picks the first of each part."""
    spark = found.sparkSession
    rules = F.broadcast(spark.createDataFrame(_rules(), "rel string, field string, rank int, offer int"))
    above = F.transform(F.sequence(F.lit(1), F.least(F.lit(6), F.size("path"))), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("path", -k, k), ".").alias("rel")))
    rows = found.withColumn("a", F.explode(above)).join(rules, F.col("a.rel") == F.col("rel"))
    up = F.size("path") - F.col("a.k")
    text = F.nullif(F.trim(F.regexp_replace("value", r"\s+", " ")), F.lit(""))
    named = F.when((F.length("t") <= 160) & ~F.col("t").rlike(r"(?i)^(?:null|undefined|unknown|n/a)$"), F.col("t"))
    digits = F.regexp_replace("t", r"\D", "")
    value = (
        F.when(F.col("field") == "title", F.nullif(plain_text("t"), F.lit("")))
        .when(F.col("field").isin("sku", "product_id", "tcin"), named)
        .when(F.col("field").isin("upc", "gtin"), F.when(F.length(digits).isin(8, 12, 13, 14), digits))
        .when(F.col("field") == "type", F.regexp_extract(F.lower("t"), r"([^/#:]+)[/#:]*$", 1))
        .otherwise(F.col("t"))
    )
    rows = rows.select(key, "position", "kind", F.slice("place", F.lit(1), up).alias("node"), F.slice("path", F.lit(1), up).alias("path"), F.slice("place", F.lit(1), F.when(F.col("offer") > 0, up + F.col("offer")).otherwise(0)).alias("offer"), "field", F.struct("rank", "place").alias("at"), text.alias("t"))
    money = F.col("field").isin("price", "last_price", "regular", "offer_price", "offer_regular")
    rows = rows.where("t IS NOT NULL").withColumn("value", value).withColumn("amount", F.when(money, _amount(F.col("t"))))
    rows = rows.where(F.when(money, F.col("amount").isNotNull()).otherwise(F.col("value").isNotNull()))
    first = lambda f, c: F.min_by(c, F.when(F.col("field") == f, F.col("at"))).alias(f)
    # Own parts and each offer's, then one row an object.
    each = rows.groupBy(key, "position", "kind", "node", "path", "offer").agg(
        *[first(f, "value") for f in ("title", "url", "sku", "upc", "gtin", "product_id", "tcin", "state", "image", "currency", "offer_state", "offer_currency")],
        *[first(f, "amount") for f in ("price", "last_price", "regular", "offer_price", "offer_regular")],
        F.collect_set(F.when(F.col("field") == "type", F.col("value"))).alias("types"),
    )
    each = each.withColumn("_open", F.when(state_of("offer_state") != "out_of_stock", F.col("offer_price")))
    own = F.size("offer") == 0
    whole = each.groupBy(key, "position", "kind", "node", "path").agg(
        *[F.max(F.when(own, F.col(f))).alias(f) for f in ("title", "url", "sku", "upc", "gtin", "product_id", "tcin", "state", "image", "currency", "price", "last_price", "regular")],
        F.min("_open").alias("_open"), F.min("offer_price").alias("_any"), F.max("offer_regular").alias("_most"),
        F.min_by("offer_state", F.when(F.col("offer_state").isNotNull(), F.col("offer"))).alias("_state"),
        F.min_by("offer_currency", F.when(F.col("offer_currency").isNotNull(), F.col("offer"))).alias("_currency"),
        F.flatten(F.collect_list("types")).alias("types"),
    )
    whole = whole.where("title IS NOT NULL")
    schema = F.arrays_overlap("types", F.array(*map(F.lit, PRODUCT_TYPES)))
    other = F.arrays_overlap("types", F.array(*map(F.lit, OTHER_TYPES)))
    noise = F.exists("path", lambda p: F.lower(F.regexp_replace(p, r"(?i)[^a-z0-9]+", "")).isin(NOISE_PATHS))
    whole = whole.withColumn("schema", schema).where(F.col("schema") | ~(other | noise)).withColumn("_plain", F.trim(F.regexp_replace(F.lower("title"), r"[^a-z0-9$]+", " ")))
    whole = whole.where(F.length("_plain").between(3, 300) & ~F.col("_plain").rlike(r"^\$?\d+(?: \d{1,2})?$") & ~F.col("_plain").rlike(NOISE_TITLE))
    for c in ("url", "image"):
        whole = whole.withColumn("_known", absolute(c, F.col(page_url))).withColumn(c, without_tracking("_known"))
    whole = whole.withColumn("url", F.when(~F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("/")).rlike(NO_PRODUCT_PATH), F.col("url")))
    whole = whole.withColumn("gtin", F.coalesce("gtin", "upc")).withColumn("upc", F.coalesce("upc", F.when(F.length("gtin") == 12, F.col("gtin"))))
    whole = whole.withColumn("price", F.coalesce("price", "_open", "_any", "last_price")).withColumn("regular", F.coalesce("regular", "_most"))
    whole = whole.withColumn("regular", F.when(F.col("price").isNull() | (F.col("regular") > F.col("price")), F.col("regular")))
    whole = whole.withColumn("state", state_of(F.coalesce("state", "_state"))).withColumn("currency", F.upper(F.coalesce("currency", "_currency")))
    identity = F.coalesce("url", "sku", "gtin", "product_id", "tcin").isNotNull()
    commerce = F.col("price").isNotNull() | F.col("regular").isNotNull() | (F.col("state") != "unknown")
    whole = whole.where(F.when(F.col("schema"), identity).otherwise(identity & commerce))
    return whole.select(key, "position", "kind", F.col("node").alias("place"), "title", "url", "sku", "product_id", "tcin", "gtin", "upc", "price", "regular", "state", "image", F.when(F.col("currency").rlike("^[A-Z]{3}$"), F.col("currency")).alias("currency"))


def _identity_url(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, r"/+(?=$|\?)", ""))


def merged(rows: DataFrame, key: str) -> DataFrame:
    """One row for each product of a page: rows that share an identity, transitively, are one product.

    Of a product the least price and the highest regular price above it count, the best state, the title and address
    with most to say, and the first known of all other parts, by the order in which a page shows them."""
    rows = stored(rows.withColumn("_id", F.monotonically_increasing_id()), "page-products")
    low = lambda c: F.lower(F.trim(c))
    names = {"product": low("product_id"), "tcin": low("tcin"), "gtin": F.col("gtin"), "upc": F.col("upc"), "sku": low("sku"), "url": _identity_url(F.col("url"))}
    keys = rows.select("_id", *[F.when(v.isNotNull(), F.to_json(F.struct(F.col(key).alias("k"), v.alias("v")))).alias(f"_{k}") for k, v in names.items()])
    groups = transitive_groups(keys, "_id", [f"_{k}" for k in names])
    each = rows.join(groups, "_id").withColumn("_at", F.struct("position", "place", "_id"))
    score = F.length("title") + F.when(F.col("title").rlike(LIKE_A_RECORD), 20).otherwise(0)
    depth = F.size(F.filter(F.split(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")), "/"), lambda p: p != ""))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c)
    rank = F.array_position(F.array(*map(F.lit, STATE_ORDER)), F.col("state"))
    least = each.groupBy(key, "group").agg(
        F.min("_at").alias("_at"),
        F.count(F.lit(1)).alias("evidence"),
        F.min_by("title", F.struct((-score).alias("s"), "_at")).alias("title"),
        F.min_by("url", F.when(F.col("url").isNotNull(), F.struct((-depth).alias("d"), "_at"))).alias("url"),
        F.min_by("image", F.when(F.col("image").isNotNull(), F.struct((~F.col("image").startswith("https://")).alias("s"), "_at"))).alias("image"),
        *[first(c) for c in ("sku", "product_id", "tcin", "gtin", "upc", "currency")],
        F.min("price").alias("price"),
        F.array_sort(F.collect_set("regular")).alias("_regular"),
        F.max_by("state", rank).alias("state"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("kind"))), lambda k: k["kind"]), ",").alias("kinds"),
    )
    above = F.array_max(F.filter("_regular", lambda r: F.col("price").isNull() | (r > F.col("price"))))
    identity = F.coalesce(*[F.concat(F.lit(f"{k}:"), v) for k, v in names.items()])
    available = F.when(F.col("state").isin("in_stock", "limited_stock"), True).when(F.col("state") == "out_of_stock", False)
    order = F.row_number().over(Window.partitionBy(key).orderBy("_at"))
    return least.select(key, order.alias("rank"), identity.alias("stable_id"), "title", "url", "sku", "product_id", "tcin", "gtin", "upc", "price", above.alias("regular"), "state", available.alias("available"), "image", "currency", "kinds", "evidence")


def catalogue(pages: DataFrame, key: str, html: str = "html", url: str = "url") -> DataFrame:
    """The products of pages, from their payloads."""
    found = payloads(pages.withColumn("_key", F.struct(F.col(key).alias("key"), F.col(url).alias("url"))), "_key", html)
    rows = products(leaves(found, "_key"), "_key", "_key.url")
    return merged(rows.withColumn(key, F.col("_key.key")).drop("_key"), key)

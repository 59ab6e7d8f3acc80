"""Whether a listing is a record for sale: ordered reject rules, then an additive score; and whether a find is worth a look."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .decisions import chosen, metadata_score
from .money import clamp, col
from .text import fold_latin

# What titles, types, tags and addresses say about a product. \b is a boundary of ASCII words.
NAVIGATION = r"^(?:all|back|browse|cart|clearance|contact|deals?|discover|explore|featured|filter\s+amazon(?:\s+by\s+price)?|home|learn\s+more|log\s*in|lps?|menu|more|new|new\s+releases|next|previous|records?|sale|search|shop|shop\s+(?:all|now)|sign\s+in|specials?|view\s+(?:all|details|more)|vinyl)[\s!→›»]*$"
PRODUCT_PATH = r"/(?:albums?|catalog|dp|ip|items?|music|p|product-detail|products?|releases?|sku|title|w)/"
VINYL = r"\b(?:vinyl|phonograph\s+record|record\s+album|(?:[1-9]\s*(?:[x×-]\s*)?)?lp|ep|(?:7|10|12)\s*(?:inch|in\.|[\"”]))\b"
MUSIC_SHAPE = r"(?:\s[-–—:|]\s)|\b(?:album|anniversary|audiophile|edition|exclusive|gatefold|mono|remaster(?:ed)?|soundtrack|stereo)\b"
OTHER_MEDIA = r"\b(?:4k\s+uhd|bag|blanket|blu[\s-]?ray|book|bottle|calendar|cassette|(?:\d+\s*x?\s*)?cds?|compact\s+disc|deck\s+bundle|dvd|earrings?|figurine|gift\s+card|guitar\s+picks?|hat|hoodie|jewelry|keychain|koozie|magazine|merch(?:andise)?\s+bundle|mug|necklace|ornament|patch|pin|pizza\s+cutter|placemat|poster|record\s+players?|shirt|slip\s*mat|socks|steelbook|sticker|sweatshirt|t[\s-]?shirts?|tee|tote|trading\s+card|turntables?|uhd|wallet|zine)\b"
DIGITAL = r"\b(?:digital|download|flac|mp3|streaming|wav)\b"
RETAIL_NOISE = r"\b(?:air\s+fryer|apparel|automotive|baby|bathing\s+suits?|beauty|bedding|bicycles?|bikinis?|bra(?:lette)?|bucket|cable|car\s+wash|cat\s+treats?|charger|cleaning|clothing|coffee|comforter|coolers?|cosmetics|decorations?|dish\s+soap|electronics?|eyeshadow|fitness\s+tracker|food|gimmicks?|goggles|granola|grocery|groceries|hair|handbags?|headphones?|ice\s+packs?|kitchen|knife|laundry|laptop|makeup|manicure|mattress|nail\s+colou?r|ornament|pants|paprika|pencils?|pens?|phone|protein|purse|sauce|screwdrivers?|shampoo|shoes?|shorts|skin\s*care|smart\s*watch|smartwatch|snacks?|speaker|supplement|swimdress|swimsuits?|swimwear|tablet|toothpaste|toys?|tuna|underwear|webcam|wipes?)\b"
ACCESSORY = r"\b(?:45\s+adapter|cartridge|cleaning\s+(?:brush|fluid|kit)|coasters?|decal|display\s+frame|inner\s+sleeves?|label\s+decal|needle|non[- ]?adhesive\s+label|outer\s+sleeves?|paper\s+label|platter\s+mat|record\s+bowl|record\s+cleaner|replacement\s+(?:cover|jacket|sleeve|stylus)|slip\s*mat|stylus|storage\s+crate|turntable\s+(?:platter\s+)?mat|wall\s+clock)\b"
NOT_A_RECORD = r"\b(?:decal|label\s+decal|non\s+adhesive\s+label|paper\s+label|platter\s+mat|record\s+bowl|drink\s+coasters?|coasters?\s+(?:set|pack)|replacement\s+(?:cover|jacket|sleeve)|slip\s*mat|turntable\s+(?:platter\s+)?mat|wall\s+(?:art|clock|decor)|(?:tote|canvas|shoulder|shopping)\s+bags?|earrings?|cufflinks?|keychains?|jewel(?:ry|lery)|phone\s+case)\b|\b(?:vinyl|record|lp).{0,40}\b(?:bowl|decal|floor\s+mat|label\s+decal|mouse\s+mat|paper\s+label|platter\s+mat|record\s+mat|turntable\s+(?:platter\s+)?mat|wall\s+(?:art|clock|decor))\b|\b(?:bowl|floor\s+mat|mouse\s+mat|wall\s+(?:art|clock|decor)).{0,40}\b(?:vinyl|record|lp)\b|\b(?:made|crafted|cut)\s+from\s+(?:an?\s+)?(?:recycled|upcycled)\s+(?:vinyl\s+)?records?\b"
PROMOTION = r"^(?:bogo|buy\s+(?:one|1)|extra\s+\d|free\s+shipping|get\s+(?:one|1)|members?\s+only|prime\s+members?|save\s+\d|select\s+(?:accounts?|items?|titles?)|up\s+to\s+\d|\d+\s*%\s*off)\b"
NOT_NEW = r"(?:^\s*[\[(]?\s*damaged\b|\b(?:damaged|used|pre[-\s]?owned)\s+(?:copy|lp|record|vinyl)\b|\b(?:open[\s-]?box|scratch\s+and\s+dent|shopworn)\b|/(?:collections|products?)/(?:damaged|pre[-_]?owned|used)(?:[-_/]|$))"
EXPIRED = r"\bthread:expired:true\b"
MARKETPLACE = r"\b(?:barnes-noble|barnes\s+&\s+noble|target|urban-outfitters|urban\s+outfitters|walmart)\b"
AGGREGATOR = r"\bcheap-vinyl\b|\bcheap\s+vinyl\b"
AGGREGATOR_LABEL = r"^(?:filter\s+amazon(?:\s+vinyl\s+records?)?\s+by\s+price|(?:vinyl\s+)?records?\s+under\s+\$?\d+|vinyl\s+under\s+\$?\d+|under)$"
BOOK_NUMBER = r"(?:[?&]ean=)(?:978|979)\d{10}\b"
DIGITAL_ALBUM = r"/[^/?#]*digital[-_/]album(?:[/?#]|$)"
RECORD_SHOP = r"\b(?:vinyl|record|records|lps?|audiophile|soundtrack|label)\b"
PRODUCT_SALE = r"\b(?:final\s+sale|clearance|closeout|super\s+sale|warehouse\s+(?:sale|overstock)|overstock|garage\s+sale|special\s+price|daily\s+deal|deep\s+discount|price\s+drop|vinyl\s+discount|buy\s+more\s+save\s+more|under\s+\$?\s*(?:10|15|20)|bogo|buy\s+(?:one|1|2)\s+get\s+(?:one|1)|[3-9][0-9]\s*%\s*off)\b"
DEAL_SOURCE = r"\b(?:final|clearance|closeout|super-sale|super\s+sale|deep-cuts|deep\s+cuts|deep-discount|deep\s+discount|on-sale|on\s+sale|deals?|daily-deal|specials?|special-price|price-drop|price\s+drop|cheap-vinyl|cheap\s+vinyl|slickdeals|discount|warehouse|overstock|garage|volume-sale|buy-more-save-more|under-?1?[0459]9?9?)\b"
VOLUME_OFFER = r"\b(?:bogo|buy-more-save-more|buy\s+more\s+save\s+more|volume-sale|volume\s+sale)\b"
UNAVAILABLE = r"\b(?:discontinued|out[_ -]?of[_ -]?stock|sold[_ -]?out|unavailable)\b"

_BOUNDARY = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def ascii_words(pattern: str) -> str:
    """The pattern for letters of either case, \\b as a boundary of ASCII words."""
    return "(?i)" + pattern.replace(r"\b", _BOUNDARY)


def says(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs."""
    return F.coalesce(text.rlike(ascii_words(pattern)), F.lit(False))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def folded(text: Column) -> Column:
    """White space folded and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def not_a_record(text) -> Column:
    """Whether a marketplace title names something made of, for or about records instead of one."""
    return says(F.trim(F.regexp_replace(fold_latin(F.regexp_replace(F.coalesce(col(text), F.lit("")), "([À-ž])", "$1 ")), r"(?i)[^a-z0-9]+", " ")), NOT_A_RECORD)


def assess(title, kind, tags, context, url, source: dict[str, object] | None = None) -> dict[str, Column]:
    """reject (null where accepted) and score of a listing.

    source: any of id, name, url, group, type, crawl, priority, likelihood and noise of where it was found."""
    text = lambda c: F.coalesce(col(c), F.lit(""))
    of = lambda name: F.coalesce(col((source or {}).get(name, F.lit(None))).cast("string"), F.lit(""))
    name = folded(text(title))
    link, around = text(url), text(context)
    direct = folded(F.concat_ws(" ", name, text(kind), text(tags)))
    path = path_of(link)
    everything = folded(F.concat_ws(" ", direct, F.regexp_replace(path, r"[-_/]+", " ")))
    explicit = says(direct, VINYL)
    contextual, product, shaped = explicit | says(around, VINYL), says(path, PRODUCT_PATH), says(name, MUSIC_SHAPE)
    identity = F.lower(F.concat_ws(" ", of("id"), of("name")))
    focused = says(F.concat_ws(" ", of("id"), of("name"), of("url"), of("group"), of("type")), RECORD_SHOP)
    cheap = says(identity, AGGREGATOR)
    reject = chosen(
        [
            (F.length(name) < 3, "title_too_short"),
            (says(name, NAVIGATION), "navigation_label"),
            (says(link, EXPIRED), "expired_deal"),
            (says(F.concat_ws(" ", direct, F.regexp_replace(path, r"[-_/]+", " ")), NOT_NEW), "non_new_condition"),
            (not_a_record(everything) | says(everything, ACCESSORY), "record_accessory"),
            (((of("type") == "marketplace_retailer") | says(identity, MARKETPLACE)) & ~explicit, "marketplace_requires_explicit_vinyl"),
            (says(link, BOOK_NUMBER), "isbn_book_listing"),
            (cheap & says(name, AGGREGATOR_LABEL), "deal_category_navigation"),
            (cheap & ~explicit & ~shaped, "deal_aggregator_requires_record_title"),
            (says(link, DIGITAL_ALBUM), "digital_only_product"),
            (says(everything, OTHER_MEDIA), "non_vinyl_format"),
            (says(direct, DIGITAL) & ~explicit, "non_vinyl_format"),
            (says(everything, RETAIL_NOISE) & ~explicit, "non_music_retail_category"),
            (says(name, PROMOTION) & ~shaped, "promotion_label"),
            (~explicit & ~shaped & says(around, RETAIL_NOISE), "non_music_retail_context"),
            (~explicit & ~product, "no_product_or_format_signal"),
            (~contextual & ~focused & ~shaped, "weak_record_signal"),
        ]
    )
    shop = metadata_score(of("priority").try_cast("double"), of("likelihood"), of("noise"), F.when(of("crawl") == "deal-aggregator", of("crawl")).otherwise(of("type")))
    format_points = F.when(explicit, 35).when(contextual, 10).otherwise(0)
    points = F.lit(20) + format_points + F.when(product, 15).otherwise(0) + F.when(shaped, 8).otherwise(0) + F.when(focused, 8).otherwise(0) + shop
    return {"reject": reject, "score": F.when(reject.isNull(), clamp(points, 0, 100)).otherwise(0.0)}


def high_signal(find: dict[str, object]) -> Column:
    """Whether a find has a reason to be looked at: a deal source, a sale signal, a real markdown or a low verified price, and then margin.

    find: columns source_id, source_name, source_url, discovery_url, collection, listing_title, price, original_price, discount_percent, threshold,
    quality, sold_price, sold_shipping, sold_count, noise, available, sold_by_source, stock, verified_direct_us and discovery_only; any may be left out."""
    given = lambda name, kind="string": col(find.get(name, F.lit(None))).cast(kind)
    text = lambda name: F.coalesce(given(name), F.lit(""))
    price, original, threshold = given("price", "double"), given("original_price", "double"), given("threshold", "double")
    where = F.concat_ws(" ", text("source_url"), text("discovery_url"), text("collection"))
    walmart = says(F.concat_ws(" ", text("source_id"), text("source_name"), where), r"\bwalmart\b")
    gone = F.coalesce(~given("available", "boolean"), F.lit(False)) | says(text("stock"), UNAVAILABLE)
    blocked = walmart & (F.coalesce(~given("sold_by_source", "boolean"), F.lit(False)) | gone)
    low_price = F.coalesce((price > 0) & (price <= 20) & ~gone & given("verified_direct_us", "boolean"), F.lit(False))
    trusted = says(F.concat_ws(" ", text("source_id"), text("source_name"), where), DEAL_SOURCE) & ~F.coalesce(given("discovery_only", "boolean"), F.lit(False))
    on_sale = says(F.concat_ws(" ", text("listing_title"), where), PRODUCT_SALE)
    cut = F.coalesce(original > price, F.lit(False))
    discount = F.coalesce(given("discount_percent", "double") / 100, F.when(cut, (original - price) / original), F.lit(0.0))
    configured = F.coalesce((threshold > 0) & (discount >= threshold), F.lit(False))
    least = F.when(threshold > 0, F.greatest(F.lit(0.25), threshold - 0.15)).otherwise(0.3)
    markdown = cut & (discount >= least) & F.coalesce(given("quality", "double") >= 70, F.lit(False))
    unpriced = says(where, VOLUME_OFFER) & (discount <= 0)
    sale = F.when(given("sold_price", "double") > 0, given("sold_price", "double") + F.coalesce(given("sold_shipping", "double"), F.lit(0.0)))
    margin = sale - price
    noisy = text("noise") == "high"
    sells = ((margin >= 5) & (F.coalesce(given("sold_count", "long"), F.lit(0)) >= 2)) | (margin >= 10) | ((sale >= 25) & (price <= 15))
    return F.coalesce(
        chosen(
            [
                (blocked, False),
                (~(trusted | on_sale | configured | markdown | low_price), False),
                (unpriced, False),
                (low_price, True),
                (sale.isNotNull(), sells),
                (configured | markdown, price <= F.when(noisy, 30).otherwise(100)),
            ],
            (price <= F.when(noisy, 30).otherwise(45)) & (trusted | on_sale),
        ),
        F.lit(False),
    )

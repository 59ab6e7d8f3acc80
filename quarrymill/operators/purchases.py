"""Purchase listings of a marketplace: an ordered list of reject rules, one candidate for each item over all lanes, counts by lane and rule, and what an item's detail says it is.

Listings and details are raw JSON texts. What a rule needs and doesn't find is unknown, never zero. Assessed details and what `discover` reads of assessed
listings are stored in the shared folder, so that texts are parsed and rules tried once, however many results are drawn from them; the raw texts are not kept.
Assessed listings themselves are not stored: a caller that draws several results from them stores them (`storage.stored`, `storage.discard`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.candidates import NOT_A_RECORD, folded
from ..functions.decisions import chosen
from ..functions.money import EPSILON, col, computed, known_amount, let, positive_amount
from ..functions.text import fold_latin
from ..functions.urls import part
from .storage import stored

# The category of records, the condition of new items, and the least a seller must have.
CATEGORY, NEW = "176985", "1000"
SELLER_SCORE, SELLER_PERCENTAGE = 25, 97.0
HOSTS = r"(?i)(?:^|\.)ebay\.(?:com|co\.uk|ca|com\.au|de|fr|it|es)$"
GONE = r"OUT_OF_STOCK|UNAVAILABLE|SOLD_OUT"
# What a title says that is no record, and what says it is one.
NO_RECORD_TITLE = [
    r"\b(?:audio\s+cd|compact\s+disc|cd\s+only|cassette|8\s*track|dvd|blu\s*ray|minidisc)\b",
    r"\b(?:t[ -]?shirt|hoodie|sweatshirt|poster|calendar|magazine|book|sticker|patch|enamel\s+pin)\b",
    r"\b(?:record\s+player|turntable|stylus|replacement\s+needle|slipmat|cleaning\s+kit|record\s+cleaner)\b",
    r"\b(?:record|vinyl|lp)\s+(?:mailers?|shipping\s+boxes?|protectors?|cleaning\s+(?:brush|cloth|fluid))\b",
    r"\b(?:outer|inner)\s+(?:record\s+|vinyl\s+|lp\s+)?sleeves?(?:\s+protectors?)?\b",
    r"\b(?:record|vinyl|lp)\s+(?:outer|inner)\s+sleeves?\b",
    r"\b(?:cleaning\s+(?:brush|cloth|fluid)|sleeve\s+protector|record\s+mailer)\b",
    r"\b(?:record|vinyl|lp).{0,32}\b(?:weight|stabilizer|clamp|anti[- ]?static\s+brush|replacement\s+(?:sleeve|jacket|cover)|divider\s+tabs?)\b",
    r"\b(?:weight\s+stabilizer|stabilizer\s+clamp|anti[- ]?static\s+brush|replacement\s+(?:sleeve|jacket|cover)|divider\s+tabs?)\b",
    r"\b(?:vinyl|record|lp).{0,40}\b(?:bowl|coasters?|decal|paper\s+label|label\s+decal|non[- ]?adhesive\s+label|turntable\s+(?:platter\s+)?mat|platter\s+mat|record\s+mat|lp\s+mat|floor\s+mat|mouse\s+mat|wall\s+clock)\b",
    r"\b(?:decal|paper\s+label|label\s+decal|non[- ]?adhesive\s+label)\b",
    r"\b(?:sleeve|jacket|cover)\s+only\b",
    r"\b(?:record|vinyl)\s+(?:storage|case|holder|stand|display|frame|rack|shelf|coaster|clock)\b",
    r"\b(?:lot\s+of|job\s+lot|record\s+lot|vinyl\s+lot|record\s+collection|vinyl\s+collection|mystery\s+box|random\s+bundle)\b",
]
RECORD_TITLE = r"\bvinyl\b|\blp\b|\bphonograph\s+record\b|\b(?:33(?:\s+1\s+3)?|45)\s*rpm\b|(?:^|\s)(?:7|10|12)\s*(?:inch|inches)(?:\s|$)"
# What a detail says that is an accessory, and the names and values of aspects that tell what an item is.
ACCESSORY_DETAIL = r"\b(?:decal|sticker|non\s+adhesive\s+label|paper\s+label|label\s+decal|replacement\s+(?:sleeve|jacket|cover)|sleeve\s+only|jacket\s+only|cover\s+only|record\s+mailer|record\s+protector|record\s+cleaning|cleaning\s+(?:brush|cloth|fluid|kit)|record\s+(?:weight|stabilizer|clamp|divider|storage|display|frame|bowl)|turntable\s+(?:platter\s+)?mat|platter\s+mat|mat\s+for\s+(?:a\s+)?turntables?|record\s+mat|lp\s+mat|slipmat|replica\s+record|miniature\s+record|wall\s+(?:art|clock|decor)|decorative\s+wall|vinyl\s+(?:record\s+)?clock|record\s+coasters?|(?:tote|canvas|shoulder|shopping)\s+bags?|earrings?|keychains?|jewel(?:ry|lery)|phone\s+case)\b"
ACCESSORY_TYPE = r"^(?:decal|label|mat|record mat|slipmat|sticker|sleeve)$"
TYPE, FORMAT, MATERIAL, BINDING, KEYWORD = r"^(?:type|product type|item type)$", r"^(?:format|record format)$", r"^material$", r"^binding$", r"^item type keyword$"
ARTIST, RELEASE, ITEM_NAME = r"^artist$", r"^(?:album name|record title|release title)$", r"^item name$"
RECORD_ASPECT = r"^(?:catalog number|record grading|record size|speed)$"
RECORD_TYPE = r"^(?:album|box set|ep|lp|maxi single|record|single|vinyl record|vinyl records)$"
RECORD_FORMAT = r"\b(?:vinyl|record|lp|33 rpm|45 rpm|12 inch|10 inch|7 inch)\b"
OTHER_FORMAT = r"\b(?:8 track|audio cd|blu ray|cassette|cd|compact disc|digital|download|dvd|mp3)\b"

_MONEY = "struct<value:string,currency:string>"
_ITEM = (
    f"itemId string, legacyItemId string, title string, buyingOptions array<string>, conditionId string, leafCategoryIds array<string>, categories array<struct<categoryId:string>>, itemEndDate string, estimatedAvailabilityStatus string, "
    f"estimatedAvailabilities array<struct<estimatedAvailabilityStatus:string>>, price {_MONEY}, shippingOptions array<struct<shippingCostType:string,shippingCost:{_MONEY}>>, itemWebUrl string, itemLocation struct<country:string>, "
    "seller struct<username:string,sellerAccountType:string,feedbackScore:string,feedbackPercentage:string>"
)
# What JSON itself doesn't allow is damage, and so are values of another type than asked for; the text is then kept in _damage.
STRICT = {"columnNameOfCorruptRecord": "_damage", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_DETAIL = "title string, shortDescription string, description string, localizedAspects array<struct<name:string,value:string>>"
_CANDIDATE = ["item_id", "artist", "title", "listing_title", "price_cents", "item_cents", "shipping_cents", "currency", "country", "seller", "seller_score", "seller_percentage", "url", "destination_verified"]


def plain_words(text) -> Column:
    """ASCII words in lower case; apostrophes go, a marked Latin letter ends its word. Null counts as empty."""

    def words(t: Column) -> Column:
        marked = fold_latin(F.regexp_replace(F.replace(t, F.lit("’"), F.lit("")), "([À-ž])", "$1 "))
        plain = F.when(F.octet_length(t) == F.length(t), t).otherwise(marked)
        return F.trim(F.lower(F.regexp_replace(F.replace(plain, F.lit("'"), F.lit("")), r"(?i)[^a-z0-9]+", " ")))

    return let(F.coalesce(col(text), F.lit("")), words)


def _said(text) -> Column:
    """White space folded; null for nothing."""
    return let(folded(col(text)), lambda t: F.when(t != "", t))


def _word(text) -> Column:
    """A text without white space around it, in upper case, to be compared with a single word: cheaper than folding what stands inside."""
    return F.upper(F.btrim(col(text), F.lit(" \t\n\x0b\f\r")))


def _list(values) -> Column:
    """The texts of a list that say something; null counts as empty."""
    return F.filter(F.transform(F.coalesce(col(values), F.array().cast("array<string>")), _said), lambda v: v.isNotNull())


def _cents(amount: Column) -> Column:
    return F.floor((amount + EPSILON) * 100 + 0.5).cast("long")


def _object(raw, damage=None) -> Column:
    """Whether a text is a JSON object. damage: null where the text was already parsed without a complaint, which spares another look at it."""
    sound = F.try_parse_json(col(raw)).isNotNull() if damage is None else damage.isNull() | F.try_parse_json(col(raw)).isNotNull()
    return F.coalesce(F.startswith(F.ltrim(col(raw)), F.lit("{")) & sound, F.lit(False))


def _of_lane(lane, lanes: list[dict], name: str, kind: str) -> Column:
    """A setting of a row's lane; lanes are a caller's short list, so it is an expression and no join."""
    known = [(col(lane) == x["id"], F.lit(x[name]).cast(kind)) for x in lanes if x.get(name) is not None]
    return chosen(known, F.lit(None).cast(kind)) if known else F.lit(None).cast(kind)


def assess_items(rows: DataFrame, raw: str, lane: str, lanes: list[dict], as_of, *, category: str = CATEGORY, currency: str = "USD", country: str = "US", postal_code: str | None = None, seller_score: float = SELLER_SCORE, seller_percentage: float = SELLER_PERCENTAGE, title_must_say: bool = True) -> DataFrame:
    """rows with `reject`, the first rule that a listing breaks (null where it is accepted), and the columns of a candidate.

    lanes: dicts of id, min_cents and max_cents of the all-in price, and tokens that a title must have; a row of an unknown
    lane has no bounds. as_of: listings that ended by then are unavailable. Null, empty and damaged texts are invalid items.
    Columns of rows with the names of a candidate's are replaced."""
    r = computed(rows, {"_i": F.from_json(F.col(raw), f"{_ITEM}, _damage string", STRICT)})
    f = lambda name: F.col(f"_i.{name}")
    up = lambda c: F.upper(_said(c))
    options = F.coalesce(f("shippingOptions"), F.array())
    fixed = F.filter(options, lambda o: (_word(o["shippingCostType"]) == "FIXED") & (up(o["shippingCost"]["currency"]) == currency))
    quotes = F.filter(F.transform(fixed, lambda o: known_amount(o["shippingCost"]["value"].try_cast("double"))), lambda v: v.isNotNull())
    other = F.exists(options, lambda o: F.coalesce((_word(o["shippingCostType"]) != "FIXED") & (_word(o["shippingCostType"]) != ""), F.lit(False)))
    price, shipping = positive_amount(f("price.value").try_cast("double")), F.array_min(F.transform(quotes, _cents))
    states = _list(F.concat(F.array(f("estimatedAvailabilityStatus")), F.coalesce(F.transform(f("estimatedAvailabilities"), lambda e: e["estimatedAvailabilityStatus"]), F.array().cast("array<string>"))))
    gone = F.coalesce(f("itemEndDate").try_cast("timestamp") <= F.lit(as_of).cast("timestamp"), F.lit(False)) | F.exists(states, lambda s: F.upper(s).rlike(GONE))
    link = f("itemWebUrl")
    good_link = F.coalesce(F.lower(part(link, "PROTOCOL")).isin("http", "https") & part(link, "HOST").rlike(HOSTS), F.lit(False))
    bounded = known_amount(f("seller.feedbackPercentage").try_cast("double"))
    score, percentage = F.floor(known_amount(f("seller.feedbackScore").try_cast("double"))).cast("long"), F.when(bounded <= 100, bounded)
    name, code, origin = _said(f("title")), up(f("price.currency")), up(f("itemLocation.country"))
    in_category = let(_list(f("leafCategoryIds")), lambda leaf: F.when(F.size(leaf) > 0, F.array_contains(leaf, category)).otherwise(let(_list(F.transform(f("categories"), lambda c: c["categoryId"])), lambda c: (F.size(c) == 0) | F.array_contains(c, category))))

    def of_title(words: Column) -> Column:
        no_record = words.rlike(NOT_A_RECORD)
        for pattern in NO_RECORD_TITLE:
            no_record = no_record | words.rlike(pattern)
        around = F.concat(F.lit(" "), words, F.lit(" "))
        missing_token = F.lit(False)
        for x in lanes:
            for t in x.get("tokens") or []:
                missing_token = missing_token | F.coalesce((col(lane) == x["id"]) & ~F.contains(around, F.concat(F.lit(" "), plain_words(F.lit(t)), F.lit(" "))), F.lit(False))
        return chosen([(no_record, "non_record_title"), (~words.rlike(RECORD_TITLE) & F.lit(title_must_say), "record_signal_missing"), (missing_token, "lane_token_mismatch")])

    def of_price(sums: Column) -> Column:
        below = lambda bound: F.coalesce(sums["all_in"] < _of_lane(lane, lanes, bound, "long"), F.lit(False))
        above = lambda bound: F.coalesce(sums["all_in"] > _of_lane(lane, lanes, bound, "long"), F.lit(False))
        rules = [
            (sums["price"].isNull(), "missing_item_price"), (~F.coalesce(code == currency, F.lit(False)), "currency_mismatch"), (sums["shipping"].isNull() & other, "shipping_quote_not_fixed"),
            (sums["shipping"].isNull(), "shipping_unknown"), (below("min_cents"), "below_lane_price_floor"), (above("max_cents"), "above_lane_price_ceiling"),
        ]
        return chosen(rules)

    first = [(~_object(raw, f("_damage")), "invalid_item"), (~F.coalesce(f("title").rlike(r"\S"), F.lit(False)), "missing_title"), (~in_category, "wrong_category"), (~F.exists(F.coalesce(f("buyingOptions"), F.array()), lambda o: F.coalesce(_word(o) == "FIXED_PRICE", F.lit(False))), "not_fixed_price"), (~F.coalesce(_word(f("conditionId")) == NEW, F.lit(False)), "not_new")]
    last = [
        (~good_link, "missing_item_url"), (origin.isNull(), "item_origin_unknown"), (origin != country, "cross_border_origin"), (score.isNull() | percentage.isNull(), "seller_reputation_missing"),
        ((score < seller_score) | (percentage < seller_percentage), "seller_reputation_below_threshold"),
    ]
    sums = lambda p: F.struct(p["price"].alias("price"), p["shipping"].alias("shipping"), _cents(p["price"] + p["shipping"] / 100.0).alias("all_in"))
    paid = let(F.struct(price.alias("price"), shipping.alias("shipping")), sums)
    # Rules stand in groups, a column each: a group is only tried on what those before it let pass, and its own values are computed then, once.
    r = r.withColumn("_first", chosen(first)).withColumn("_words", F.when(F.col("_first").isNull(), plain_words(f("title"))))
    r = r.withColumn("_second", F.coalesce(F.col("_first"), of_title(F.col("_words")), F.when(gone, "unavailable"))).withColumn("_paid", F.when(F.col("_second").isNull(), paid))
    r = r.withColumn("_verdict", F.coalesce(F.col("_second"), of_price(F.col("_paid")), chosen(last)))
    r = computed(r, {"reject": F.col("_verdict")})
    parts = F.filter(F.split(name, r"\s+(?:-|–|—|\|)\s+"), lambda p: F.trim(p) != "")
    two = lambda p: (F.size(p) >= 2) & (F.length(F.get(p, F.lit(0))) <= 120)
    url = F.when(good_link, F.regexp_replace(F.trim(link), "#.*$", ""))
    # Each column is an expression of its own over the parsed item, so that what is read of accepted listings only is computed for these only.
    candidate = {
        "item_id": F.coalesce(_said(f("itemId")), _said(f("legacyItemId")), url), "artist": let(parts, lambda p: F.when(two(p), F.get(p, F.lit(0))).otherwise("Unknown Artist")), "title": let(parts, lambda p: F.when(two(p), F.array_join(F.slice(p, 2, 1 << 20), " - ")).otherwise(name)), "listing_title": name,
        "price_cents": let(paid, lambda p: p["all_in"]), "item_cents": _cents(price), "shipping_cents": shipping, "currency": code, "country": origin, "seller": _said(f("seller.username")), "seller_score": score, "seller_percentage": percentage, "url": url, "destination_verified": F.lit(bool(postal_code and postal_code.strip())),
    }
    return r.select(*[F.col(c) for c in rows.columns if c not in (*_CANDIDATE, "reject", raw)], "reject", *[candidate[c].alias(c) for c in _CANDIDATE])


def discover(judged: DataFrame, lane: str, lanes: list[dict], ordinal: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, report) of assessed listings.

    An item is one candidate however many lanes and pages show it: its cheapest listing, the first seen of equal ones (lanes in
    their order, then `ordinal`); `lanes` names all that found it. report: lane, outcome, n, where the outcome is accepted (the lane
    found it first), duplicate or the rule broken. A hot item's listings are combined before they move: an aggregate holds one struct and a count for each lane.

    Both are read from a stored table, so that listings are judged once: of a rejected listing it holds lane and rule, of an accepted one a candidate's columns and `ordinal`."""
    ids = [x["id"] for x in lanes]
    accepted = lambda name: F.when(F.col("reject").isNull(), F.col(name)).alias(name)
    judged = stored(judged.select("reject", lane, *[accepted(c) for c in dict.fromkeys((*_CANDIDATE, ordinal)) if c != lane]), "judged-listings")
    at = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col(lane)).cast("int")
    good = judged.where("reject IS NULL").withColumn("_seen", F.struct(at.alias("at"), F.col(ordinal).alias("o")))
    best = F.min_by(F.struct(*_CANDIDATE), F.struct("price_cents", "_seen", *[c for c in _CANDIDATE if c != "price_cents"])).alias("best")
    items = good.groupBy(F.lower("item_id").alias("key")).agg(best, F.min("_seen").alias("first"), *[F.count_if(F.col("_seen.at") == k + 1).alias(f"_n{k}") for k in range(len(ids))])
    found = F.filter(F.array(*[F.struct(F.lit(i).alias("lane"), F.col(f"_n{k}").alias("n"), (F.col("first.at") == k + 1).alias("first")) for k, i in enumerate(ids)]), lambda x: x["n"] > 0)
    items = items.withColumn("found", found)
    candidates = items.select("best.*", F.transform("found", lambda x: x["lane"]).alias("lanes"), F.element_at(F.array(*[F.lit(i) for i in ids]), F.col("first.at")).alias("first_lane"))
    each = items.select(F.explode("found").alias("x")).groupBy("x.lane").agg(F.count_if("x.first").alias("accepted"), F.sum("x.n").alias("n"))
    outcomes = F.array(F.struct(F.lit("accepted").alias("outcome"), F.col("accepted").alias("n")), F.struct(F.lit("duplicate").alias("outcome"), (F.col("n") - F.col("accepted")).alias("n")))
    shown = each.select("lane", F.explode(outcomes).alias("o")).select("lane", "o.outcome", "o.n").where("n > 0")
    broken = judged.where("reject IS NOT NULL").groupBy(F.col(lane).alias("lane"), F.col("reject").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return candidates, shown.unionByName(broken)


def assess_details(rows: DataFrame, raw: str) -> DataFrame:
    """rows with status (verified, rejected or unknown), reason (null where verified) and evidence, the aspects as "name: value".

    An aspect's value may be a text or a list of texts. Null, empty and damaged details are unknown."""
    r = computed(rows, {"_d": F.from_json(F.col(raw), _DETAIL)})

    def values(aspect):
        parsed = F.coalesce(F.when(F.startswith(F.ltrim(aspect["value"]), F.lit("[")), F.from_json(aspect["value"], "array<string>")), F.array(aspect["value"]))
        once = let(_list(parsed), lambda v: F.filter(v, lambda x, i: F.array_position(F.transform(v, F.lower), F.lower(x)) == i + 1))
        return F.when(_said(aspect["name"]).isNotNull(), F.transform(once, lambda x: F.struct(_said(aspect["name"]).alias("name"), x.alias("value")))).otherwise(F.array())

    listed = F.flatten(F.transform(F.coalesce(F.col("_d.localizedAspects"), F.array()), values))
    r = computed(r, {"_a": F.transform(listed, lambda a: F.struct(a["name"].alias("shown"), F.lower(a["name"]).alias("name"), a["value"].alias("raw"), plain_words(a["value"]).alias("value")))})
    any_of = lambda name, test: F.exists("_a", lambda a: a["name"].rlike(name) & test(a["value"]))
    says = lambda name, pattern: any_of(name, lambda v: v.rlike(pattern))
    has = lambda name: any_of(name, lambda v: v != "")
    given = lambda name: any_of(name, lambda v: F.lit(True))
    all_said = F.concat_ws(" ", plain_words("_d.title"), plain_words(F.array_join(F.transform("_a", lambda a: F.concat_ws(" ", a["shown"], a["raw"])), " ")), plain_words(F.concat_ws(" ", "_d.shortDescription", "_d.description")))
    r = computed(r, {"_text": F.trim(all_said), "_marks": F.size(F.array_distinct(F.transform(F.filter("_a", lambda a: a["name"].rlike(RECORD_ASPECT) & (a["value"] != "")), lambda a: plain_words(a["name"]))))})
    accessory = F.exists("_a", lambda a: a["name"].rlike(TYPE) & F.lower(a["raw"]).rlike(ACCESSORY_TYPE)) | F.col("_text").rlike(ACCESSORY_DETAIL) | F.col("_text").rlike(NOT_A_RECORD)
    other_type = any_of(TYPE, lambda v: ~v.rlike(RECORD_TYPE))
    other_format = (given(FORMAT) & ~says(FORMAT, RECORD_FORMAT)) | says(FORMAT, OTHER_FORMAT)
    named = has(ARTIST) & has(RELEASE)
    typed = says(TYPE, RECORD_TYPE) & (says(FORMAT, RECORD_FORMAT) | (~given(FORMAT) & says(MATERIAL, r"\bvinyl\b"))) & named & (F.col("_marks") >= 1)
    bound = says(BINDING, r"\b(?:lp record|vinyl record)\b") & says(KEYWORD, r"\b(?:lp|record|vinyl)\b") & named & has(ITEM_NAME) & (F.col("_marks") >= 1)
    untyped = ~given(TYPE) & ((says(FORMAT, RECORD_FORMAT) & named & (F.col("_marks") >= 2)) | bound)
    r = r.withColumn("reason", chosen([(~_object(raw), "detail_missing"), (accessory | other_type | other_format, "detail_identifies_accessory"), (typed | untyped, F.lit(None).cast("string"))], "record_format_aspects_missing"))
    status = chosen([(F.col("reason").isNull(), "verified"), (F.col("reason") == "detail_identifies_accessory", "rejected")], "unknown")
    kept = [F.col(c) for c in rows.columns if c not in ("status", "reason", "evidence", raw)]
    found = r.select(*kept, status.alias("status"), "reason", F.transform("_a", lambda a: F.concat(a["shown"], F.lit(": "), a["raw"])).alias("evidence"))
    return stored(found, "assessed-details")


def with_details(candidates: DataFrame, details: DataFrame) -> DataFrame:
    """Candidates with the evidence of their details (item_id, status, evidence; one row each): accessories go, verified ones are known by their aspects.

    offer: official_api where identity and destination are both verified, else discovery_lead."""
    d = details.select(F.lower("item_id").alias("_key"), F.col("status").alias("_status"), F.col("evidence").alias("_evidence"))
    joined = candidates.join(d, F.lower("item_id") == F.col("_key"), "left").where("_status IS NULL OR _status <> 'rejected'")
    verified = F.coalesce(F.col("_status") == "verified", F.lit(False))
    return joined.select(*candidates.columns, F.when(verified, "detail_aspects").otherwise("summary_only").alias("identity"), F.when(verified & F.col("destination_verified"), "official_api").otherwise("discovery_lead").alias("offer"), F.coalesce("_evidence", F.array().cast("array<string>")).alias("evidence"))

"""Purchase listings: the cases of listings and details as data, damaged inputs, lanes over repeated items."""

import json

from quarrymill.operators import purchases as p

LANES = [{"id": "wide", "max_cents": 30000}, {"id": "blue", "min_cents": 1500, "max_cents": 2500, "tokens": ["blue"]}]


def item(**changes):
    base = {
        "buyingOptions": ["FIXED_PRICE"], "conditionId": "1000", "itemId": "v1|default|0", "itemLocation": {"country": "US"}, "itemWebUrl": "https://www.ebay.com/itm/123456789#x", "leafCategoryIds": ["176985"],
        "price": {"currency": "USD", "value": "10.00"}, "seller": {"feedbackPercentage": "99.8", "feedbackScore": 1200, "username": "trusted"}, "shippingOptions": [{"shippingCost": {"currency": "USD", "value": "4.00"}, "shippingCostType": "FIXED"}], "title": "Miles - Kind of Blue Vinyl LP New Sealed",
    }
    return json.dumps({k: v for k, v in (base | changes).items() if v is not None})


def quote(value, kind="FIXED", currency="USD"):
    return {"shippingCost": {"value": value, "currency": currency}, "shippingCostType": kind}


NO_RECORDS = ["Rumours Vinyl LP Outer Sleeve Protector", "Dark Side Vinyl LP Record Mailer", "Blue Vinyl LP Cleaning Brush", "Abbey Vinyl LP Inner Sleeves", "Rumours Vinyl LP Record Weight Stabilizer Clamp", "Blue Vinyl LP Anti Static Brush", "Rain Vinyl LP Replacement Jacket Cover", "Abbey Vinyl LP Divider Tabs", "Bird Vinyl Record Paper Label Decal 4-inch", "Yellow Vinyl LP Mat", "Pepper Vinyl LP Platter Mat New", "Pepper Vinyl LP Wall Clock New", "Blue Vinyl LP Coasters Set New", "Jazz Vinyl Record Bowl New", "Vinyl Record Storage Case with Handles", "Artist Album Audio CD New"]
ITEMS = [
    (item(), None), (item(buyingOptions=["AUCTION"]), "not_fixed_price"), (item(conditionId="3000"), "not_new"), (item(conditionId="1500"), "not_new"), (item(leafCategoryIds=["176984"]), "wrong_category"), (item(leafCategoryIds=None, categories=[{"categoryId": "1"}]), "wrong_category"), (item(leafCategoryIds=None), None),
    (item(shippingOptions=[]), "shipping_unknown"), (item(shippingOptions=[quote("4", "CALCULATED")]), "shipping_quote_not_fixed"), (item(shippingOptions=[quote("4", currency="CAD")]), "shipping_unknown"), (item(shippingOptions="x"), "shipping_unknown"), (item(itemLocation={"country": "GB"}), "cross_border_origin"), (item(itemLocation=None), "item_origin_unknown"),
    (item(seller={"feedbackPercentage": "96.9", "feedbackScore": 1200}), "seller_reputation_below_threshold"), (item(seller={"feedbackPercentage": "99", "feedbackScore": 24}), "seller_reputation_below_threshold"), (item(seller={"username": "new"}), "seller_reputation_missing"), (item(seller={"feedbackPercentage": "101", "feedbackScore": 99}), "seller_reputation_missing"),
    (item(title="Nina - Pastel Blues - New Sealed"), "record_signal_missing"), (item(title="  "), "missing_title"), (item(price={"value": "0", "currency": "USD"}), "missing_item_price"), (item(price={"value": "5", "currency": "EUR"}), "currency_mismatch"), (item(price={"value": "299", "currency": "USD"}), "above_lane_price_ceiling"),
    (item(itemWebUrl="https://ebay.com.evil.example/itm/1"), "missing_item_url"), (item(itemEndDate="2001-01-01T00:00:00Z"), "unavailable"), (item(estimatedAvailabilities=[{"estimatedAvailabilityStatus": "out_of_stock"}]), "unavailable"), (None, "invalid_item"), ("", "invalid_item"), ("[1]", "invalid_item"), ("{broken", "invalid_item"), ("{}", "missing_title"),
    *[(item(title=t), "non_record_title") for t in NO_RECORDS],
]


def test_first_rule_that_a_listing_breaks(spark):
    rows = spark.createDataFrame([(i, raw, "wide") for i, (raw, _) in enumerate(ITEMS)], "n long, raw string, lane string")
    got = [r.reject for r in p.assess_items(rows, "raw", "lane", LANES, "2001-11-04").orderBy("n").collect()]
    assert got == [want for _, want in ITEMS]


def test_all_in_price_and_identity(spark):
    raw = item(price={"value": 14.99, "currency": "usd"}, shippingOptions=[quote("5.00"), quote("3.50"), quote("oops"), quote("1", currency="CAD")], title="Nina Simone - Pastel Blues (180g Vinyl LP) - NEW", itemId=None)
    got = p.assess_items(spark.createDataFrame([(raw, "none", "kept")], "raw string, lane string, title string"), "raw", "lane", LANES, "2001-11-04", postal_code="90210").first()
    assert (got.reject, got.price_cents, got.item_cents, got.shipping_cents, got.artist, got.title, got.item_id, got.destination_verified) == (None, 1849, 1499, 350, "Nina Simone", "Pastel Blues (180g Vinyl LP) - NEW", "https://www.ebay.com/itm/123456789", True)
    silent = p.assess_items(spark.createDataFrame([(item(title="Nina - Pastel Blues"), "wide")], "raw string, lane string"), "raw", "lane", LANES, "2001-11-04", title_must_say=False)
    assert silent.first().reject is None


def test_lanes_over_repeated_items(spark):
    rows = [
        (0, item(itemId="A"), "wide"), (1, item(itemId="a", price={"value": "8", "currency": "USD"}), "wide"), (2, item(itemId="A", price={"value": "11", "currency": "USD"}), "blue"), (3, item(itemId="B", price={"value": "12", "currency": "USD"}), "blue"), (4, item(itemId="C", title="Green Vinyl LP"), "blue"),
        (5, item(itemId="D", price={"value": "1", "currency": "USD"}), "blue"), (6, item(itemId="E", price={"value": "90", "currency": "USD"}), "blue"), (7, None, "wide"),
    ]
    judged = p.assess_items(spark.createDataFrame(rows, "n long, raw string, lane string"), "raw", "lane", LANES, "2001-11-04")
    candidates, report = p.discover(judged, "lane", LANES, "n")
    assert {(r.item_id, r.price_cents, tuple(r.lanes), r.first_lane) for r in candidates.collect()} == {("a", 1200, ("wide", "blue"), "wide"), ("B", 1600, ("blue",), "blue")}
    assert {tuple(r) for r in report.collect()} == {("wide", "accepted", 1), ("wide", "duplicate", 1), ("wide", "invalid_item", 1), ("blue", "duplicate", 1), ("blue", "accepted", 1), ("blue", "lane_token_mismatch", 1), ("blue", "below_lane_price_floor", 1), ("blue", "above_lane_price_ceiling", 1)}
    none = p.discover(judged.limit(0), "lane", LANES, "n")
    assert none[0].count() == 0 and none[1].count() == 0


def aspects(*pairs, **more):
    return json.dumps({"localizedAspects": [{"name": a, "value": v} for a, v in pairs]} | more)


NAMED = [("Artist", "Miles"), ("Release Title", "Kind of Blue")]
BINDING = [("Binding", "lp_record"), ("Item Type Keyword", "vinyl"), ("Artist", "Miles")]
V, R, U = ("verified", None), ("rejected", "detail_identifies_accessory"), ("unknown", "record_format_aspects_missing")
DETAILS = [
    (aspects(("Type", "Label"), ("Format", "Non Adhesive Label"), ("Material", "Paper"), shortDescription="Vinyl Record Paper Label Decal"), R), *[(aspects(("Type", t), ("Format", "Record"), ("Material", "Vinyl")), R) for t in ("Clock", "Bowl", "Coaster")],
    (aspects(("Type", "LP"), ("Format", "Record"), shortDescription="Decorative platter mat for turntables"), R), (aspects(("Type", "LP"), ("Format", "Vinyl"), *NAMED, ("Record Grading", "Mint"), description="New LP in its original sleeve."), V), (aspects(("Format", "Record"), *NAMED, ("Record Grading", "Mint"), ("Record Size", "12 inch")), V),
    (aspects(*BINDING, ("Item Name", "Kind of Blue"), ("Release Title", "Kind of Blue"), ("Record Grading", "Mint")), V), (aspects(("Format", "Record"), *NAMED), U), (aspects(("Format", "Record"), *NAMED, ("Record Size", "12 inch"), ("Speed", "33"), shortDescription="Handmade wall art from a recycled record"), R), (aspects(*BINDING, ("Item Name", "Kind of Blue Wall Clock")), R),
    (aspects(*BINDING, ("Item Name", "Record Cufflinks")), R), (aspects(("Type", "LP"), ("Format", "Record"), *NAMED, ("Catalog Number", "P 1"), ("Product Type", "Cufflinks")), R), (aspects(("Type", "LP"), ("Format", ["Record", "Audio CD"]), *NAMED, ("Catalog Number", "P 1")), R), (aspects(("Type", "LP"), ("Format", "Vinyl"), ("Product", "Tote Bag")), R),
    (aspects(("Format", "Record"), *NAMED, ("Record Grading", "Mint"), ("Record Size", "12 inch"), description="Drink coasters made from recycled records"), R), (aspects(("Type", "LP"), ("Format", "Vinyl"), ("Material", "Vinyl")), U), (aspects(("Type", "LP"), ("Format", "Vinyl"), ("Artist", "The Coasters"), ("Release Title", "The Coasters"), ("Catalog Number", "AT 33")), V),
    (aspects(("Type", "LP"), ("Material", "Vinyl"), *NAMED, ("Speed", ["33", "33"])), V), (aspects(("Format", "[Vinyl]")), U), ("{}", U), (None, ("unknown", "detail_missing")), ("", ("unknown", "detail_missing")), ("{no", ("unknown", "detail_missing")), ("[]", ("unknown", "detail_missing")),
]


def test_what_details_say(spark):
    rows = spark.createDataFrame([(i, raw, "other") for i, (raw, _) in enumerate(DETAILS)], "n long, raw string, status string")
    got = p.assess_details(rows, "raw").orderBy("n").collect()
    assert [(r.status, r.reason) for r in got] == [want for _, want in DETAILS]
    assert got[18].evidence == ["Type: LP", "Material: Vinyl", "Artist: Miles", "Release Title: Kind of Blue", "Speed: 33"]


def test_details_decide_about_candidates(spark):
    c = spark.createDataFrame([("A", True), ("B", True), ("C", False), ("D", True)], "item_id string, destination_verified boolean")
    d = spark.createDataFrame([("a", "verified", ["x"]), ("B", "rejected", ["y"]), ("C", "verified", None)], "item_id string, status string, evidence array<string>")
    assert {(r.item_id, r.identity, r.offer, tuple(r.evidence)) for r in p.with_details(c, d).collect()} == {("A", "detail_aspects", "official_api", ("x",)), ("C", "detail_aspects", "discovery_lead", ()), ("D", "summary_only", "discovery_lead", ())}

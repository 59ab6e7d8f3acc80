"""What keeps queries in time on larger tables: texts are handled once, small files are spread, joins don't multiply."""

from pyspark.sql import functions as F

from quarrymill.functions import text
from quarrymill.operators import matching, purchases
from quarrymill.plans import adapters
from quarrymill.sources import cards


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_a_listing_text_is_folded_once_for_all_editions(spark):
    cases = {
        "Red Vinyl Blue, LP in Grey LP black": "color-black,color-blue,color-gray,color-red", "Remaster remastered Box Set marbled marble": "box-set,remastered,texture-marble", "5th anniversary anniversary exclusive": "anniversary-5,exclusive",
        "redvinyl monos": "standard", "The Anniversary": "anniversary", "": "standard", None: "standard",
    }
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", text.edition_identity("t").alias("e"))
    assert {r.t: r.e for r in got.collect()} == cases
    assert plan_of(spark.range(1).select(text.edition_identity(F.col("id").cast("string")).alias("e"))).count("translate(") == 1


def test_a_small_file_is_spread_over_all_cores(spark, tmp_path):
    spark.range(50).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = adapters.spread(spark.read.parquet(str(tmp_path / "t")))
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and rows.count() == 50
    assert adapters.spread(spark.range(0, 50, 1, 99)).rdd.getNumPartitions() == 99


def by_hand(items, campaigns):
    """Every item against every campaign of its source, one after another."""
    best = {}
    for item, source, collection, price in items:
        met = [c for c in campaigns if source is not None and c[1] == source] or [(None, source, None, None, None)]
        for number, _, scope, value, discount in met:
            exact = value is not None and value == collection
            good = exact or scope == "sitewide"
            rank = (not good, not exact, discount is None, -(discount or 0), number is None, number or 0)
            offer = price if not good else None if discount is None else int((price * (1 - discount / 100) + 2.220446049250313e-16) * 100 + 0.5) / 100
            if item not in best or rank < best[item][0]:
                best[item] = (rank, (item, source, price, number if good else None, offer))
    return {row for _, row in best.values()}


def test_campaigns_are_ranked_before_they_meet_items(spark):
    import random

    r = random.Random(4)
    items = [(i, r.choice([1, 2, 3, 4, None]), r.choice(["a", "b", "c", None]), 100.0 + i) for i in range(80)]
    items += [(i, 2, r.choice("abc"), 50.0) for i in range(0, 80, 7)] + [(i, 5, "c", 30.0) for i in range(0, 80, 9)]
    campaigns = [(n, r.choice([1, 2, None]), r.choice(["sitewide", "collection", None]), r.choice(["a", "b", None]), r.choice([10, 20, 30, None])) for n in range(40)]
    campaigns += [(90, 3, "collection", "a", 70), (91, 3, "sitewide", "b", None), (92, 5, "collection", "a", 40)]
    i = spark.createDataFrame(items, "id long, source int, collection string, price double")
    c = spark.createDataFrame(campaigns, "campaign_id long, source int, scope string, scope_value string, discount int")
    assert {tuple(x) for x in matching.apply_campaigns(i, c, "id", "price").collect()} == by_hand(items, campaigns)


def test_an_item_meets_no_more_rows_than_before_however_many_campaigns(spark):
    items = spark.range(3000).select("id", F.lit(1).alias("source"), F.lit("a").alias("collection"), F.lit(9.0).alias("price"))
    campaigns = spark.range(3000).select(F.col("id").alias("campaign_id"), F.lit(1).alias("source"), F.lit("sitewide").alias("scope"), F.lit("b").alias("scope_value"), F.lit(5).alias("discount"))
    got = matching.apply_campaigns(items, campaigns, "id", "price")
    assert got.where("campaign_id = 0").count() == 3000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = matching.apply_campaigns(items, campaigns, "id", "price")._jdf.queryExecution().executedPlan()
        plan.executeCollect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    rows, nodes = [], [plan]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(k) for k in range(node.children().size())]
        if "Join" in node.nodeName():
            rows.append(node.metrics().apply("numOutputRows").value())
    assert rows and max(rows) <= 3000


def test_each_part_of_a_card_is_computed_once(spark):
    pages = spark.range(9).select("id", F.lit("https://a.example/").alias("url"), F.col("id").cast("string").alias("html"))
    plan = plan_of(cards.product_cards(pages, "id"))
    assert {word: plan.count(word) for word in ("itemprop", "sale-price", "discontinued", "product-artist", "music/vinyl")} == {"itemprop": 1, "sale-price": 1, "discontinued": 1, "product-artist": 1, "music/vinyl": 1}


LANES = [{"id": "wide", "max_cents": 30000}]


def listings(spark):
    sound = '{"itemId": "%s", "title": "Miles - Blue Vinyl LP", "buyingOptions": [" fixed_price"], "conditionId": "%s", "price": {"value": 9, "currency": "USD"}, "shippingOptions": [{"shippingCostType": "Fixed ", "shippingCost": {"value": "4", "currency": "usd"}}], "itemWebUrl": "https://www.ebay.com/itm/1", "itemLocation": {"country": "US"}, "seller": {"feedbackScore": 99, "feedbackPercentage": "99", "username": "t"}}'
    texts = [sound % ("A", "1000"), sound % ("B", "3000"), (sound % ("C", "1000"))[:-1], sound.replace('"', "'") % ("D", "1000"), sound.replace(": 9,", ": NaN,") % ("E", "1000"), sound.replace('"4"', "[4") % ("F", "1000"), sound.replace('[" fixed_price"]', '" fixed_price"') % ("G", "1000")]
    return spark.createDataFrame([(n, raw, "wide") for n, raw in enumerate(texts)], "n long, raw string, lane string")


def test_a_listing_is_parsed_once_and_judged_when_it_is_read(spark):
    judged = purchases.assess_items(listings(spark), "raw", "lane", LANES, "2001-11-04")
    assert [(r.reject, r.listing_title, r.price_cents) for r in judged.orderBy("n").collect()[:2]] == [(None, "Miles - Blue Vinyl LP", 1300), ("not_new", "Miles - Blue Vinyl LP", 1300)]
    assert [r.reject for r in judged.orderBy("n").collect()[2:]] == ["invalid_item"] * 4 + ["not_fixed_price"]
    plan = plan_of(judged.where("reject IS NULL").select("item_id", "price_cents", "seller"))
    assert (plan.count("from_json"), plan.count("non_record_title"), plan.count("listing_title")) == (1, 1, 0)


def test_of_a_rejected_listing_only_lane_and_rule_are_stored(spark):
    judged = purchases.assess_items(listings(spark), "raw", "lane", LANES, "2001-11-04")
    candidates, report = purchases.discover(judged, "lane", LANES, "n")
    assert [(r.item_id, r.price_cents) for r in candidates.collect()] == [("A", 1300)]
    assert {tuple(r) for r in report.collect()} == {("wide", "accepted", 1), ("wide", "not_new", 1), ("wide", "invalid_item", 4), ("wide", "not_fixed_price", 1)}
    stored = spark.read.parquet(candidates.inputFiles()[0].rsplit("/", 1)[0])
    assert stored.count() == 7 and stored.where("reject IS NOT NULL AND (listing_title IS NOT NULL OR n IS NOT NULL OR lane IS NULL)").count() == 0

"""Column functions and decision rules on small literal cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import decisions, money, text, urls


def one(spark, column, **values):
    types = {str: "string", float: "double", int: "long", type(None): "string", bool: "boolean", list: "array<string>", datetime.datetime: "timestamp"}
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {types[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return frame.select(column.alias("x")).first().x


def test_money(spark):
    assert one(spark, money.round_half_up(F.lit(1.005))) == 1.01 and one(spark, money.round_plain(F.lit(1.005))) == 1.0
    assert one(spark, money.round_half_up(F.lit(-2.5), 0)) == -2
    assert one(spark, money.half_dollar_down(F.lit(7.99))) == 7.5
    assert one(spark, money.ratio(F.lit(1.0), F.lit(0.0))) is None and one(spark, money.ratio(F.lit(1.0), F.lit(3.0))) == 0.3333
    assert [one(spark, money.parse_price("t"), t=t) for t in ("$1,234.50 USD", "-3", "free", "12.3.4")] == [1234.5, 0, None, 12.3] or one(spark, money.parse_price("t"), t="free") == 0
    assert one(spark, money.total_price(F.lit(3.0), F.lit(None).cast("double"))) == 3
    assert [one(spark, money.confidence("t"), t=t) for t in ("high", "0.4", "7", "?")] == [1.0, 0.4, 1.0, 0.0]
    assert one(spark, money.currency_of_country("t"), t=" united kingdom ") == "GBP"
    now = datetime.datetime(2026, 7, 15, 12)
    age = lambda d: one(spark, money.age_in_days("a", "b"), a=d, b=now)
    assert age(now - datetime.timedelta(days=2, hours=1)) == 2 and age(now + datetime.timedelta(minutes=4)) == 0 and age(now + datetime.timedelta(minutes=6)) is None
    assert str(one(spark, money.short_month_date("t"), t="Jul-10-26")) == "2026-07-10"
    assert one(spark, money.max_percent("t"), t="10% or 45 % off, 120%") == 45


def test_titles(spark):
    assert one(spark, text.normalise_title("t"), t="The  Best & Worst: LP (Vinyl)!") == "best and worst"
    assert one(spark, text.sold_key("t"), t="Artist - Blue Moon Brand New/Sealed Vinyl") == "artist::blue moon"
    assert one(spark, text.sold_key("t"), t="Artist - Blue Moon VG+/VG+ Vinyl 180g") == "artist::blue moon"
    assert one(spark, text.sold_key("t"), t="Just A Name") == "just name"
    assert [one(spark, text.sold_condition("t", "l"), t=t, l=label) for t, label in (("x Factory Sealed", ""), ("x VG+/VG+", ""), ("x", "Whole lot"), ("x", ""))] == ["new_sealed", "used", "new_sealed", "unknown"]
    assert tuple(one(spark, text.grades("t"), t="x nm / vg+ y")) == ("NM", "VG+")
    assert one(spark, text.gtin("a", "b"), a="12", b="00 12345678905") == "012345678905"
    assert one(spark, text.gtin("a"), a="0123456789012") == "123456789012"
    assert one(spark, text.identity_text("t"), t="Beyoncé’s & Motörhead") == "beyonces and motorhead"
    assert one(spark, text.edition_identity("t"), t="Album (25th Anniversary) 2LP 180g Red Vinyl Target Exclusive, Marbled") == "180g,2lp,anniversary-25,color-red,exclusive-target,texture-marble"
    assert one(spark, text.edition_identity("t"), t="Album") == "standard"
    assert one(spark, text.token_similarity(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert one(spark, text.has_all_words("q", "t"), q=["a"], t=["a", "b"]) is True
    assert one(spark, text.source_family("g", "r", "c", "k", "s"), g="US Shops", r=None, c="html", k="html", s="x") == "group:us shops|crawl:html"
    assert [one(spark, text.availability("t"), t=t) for t in ("https://schema.org/InStock", "Sold Out", "Pre-order", "?")] == ["in_stock", "out_of_stock", "preorder", "unknown"]


def test_urls(spark):
    assert one(spark, urls.product_identity("u"), u="https://www.Shop.com/collections/x/products/abc/?utm_source=a&variant=7#top") == "shop.com/products/abc?variant=7"
    assert one(spark, urls.product_identity("u"), u="not a url") is None
    assert one(spark, urls.sale_page("u"), u="https://www.shop.com/Sale/page/3?utm_x=1&b=2&a=1") == "https://shop.com/sale?a=1&b=2"
    assert one(spark, urls.sale_page("u"), u="https://shop.com/collections/Sale/Extra") == "https://shop.com/collections/sale"
    assert one(spark, urls.same_host("a", "b"), a="https://www.a.com/x", b="http://a.com") is True
    assert one(spark, urls.expired_deal("u"), u="https://x/?q=thread%3Aexpired%3Atrue") is True
    assert one(spark, urls.path_offer("u"), u="https://x.com/sale-40-off") == 40 and one(spark, urls.path_offer("u"), u="https://x.com/up-to-40-off") is None


def test_cost_ledger_of_the_known_case(spark):
    """Price 10, resale 40, no inbound shipping: net 13.75 and a return of 1.2557."""
    ledger = decisions.cost_ledger(F.lit(10.0), F.lit(40.0), costs={"inbound": F.lit(0.0)})
    assert one(spark, ledger["landed_cost"]) == 10.95 and one(spark, ledger["net_profit"]) == 13.75 and one(spark, ledger["roi_ratio"]) == 1.2557
    assert one(spark, decisions.cost_ledger(F.lit(10.0), F.lit(None).cast("double"))["net_profit"]) is None


def test_velocity_of_the_known_case(spark):
    frame = spark.createDataFrame([(5.0, 12.0, 30.0, 3)], "u90 double, u365 double, u1095 double, active int")
    row = decisions.with_market(frame.withColumn("u90", F.lit(12.0)), "u90", "u365", "u1095", "active").first()
    assert row.sell_through == 0.8 and row.supply_months == 0.75 and row.days_to_sell == 23


@pytest.mark.parametrize(("prices", "ratio", "flags", "decision"), [((299, 350, 399, 425, 450, 460), 1.0, 0, "RED"), ((4700, 6000, 6700, 7600), 1.0, 0, "GREEN"), ((600, 3900, 1200), 0.33, 0, "YELLOW"), ((299, 350, 399, 425), 1.0, 2, "YELLOW")])
def test_triage(spark, prices, ratio, flags, decision):
    from quarrymill.operators.aggregates import price_summary

    rows = spark.createDataFrame([(1, p, i, ratio, flags) for i, p in enumerate(prices)], "s int, cents long, id int, r double, f int")
    p = price_summary(rows.select("s", "cents", "id"), "s", "cents").withColumns({"r": F.lit(ratio), "f": F.lit(flags), "b": F.coalesce("cheapest_ten", "median_price")})
    p = p.withColumn("c", decisions.triage_confidence("listings", "r", "f", "spread"))
    assert p.select(decisions.triage("b", "listings", "r", "f", "spread", "high_outliers", "c")["decision"].alias("d")).first().d == decision


def test_cheapest_ten_average(spark):
    from quarrymill.operators.aggregates import price_summary

    rows = spark.createDataFrame([(1, p * 100, p) for p in (12, 3, 9, 1, 2, 4, 5, 6, 7, 8, 10, 11)], "s int, cents long, id int")
    assert price_summary(rows, "s", "cents").first().cheapest_ten == 5.5


def test_seller_and_bulk(spark):
    status = lambda p, b, n, a: one(spark, decisions.seller_status(F.lit(p), F.lit(b).cast("double"), F.lit(n), F.lit(a))["status"])
    assert [status(10.0, 10.0, 3, 0), status(10.0, 10.0, 9, 0), status(13.0, 10.0, 10, 150), status(13.0, 10.0, 10, 50), status(13.0, 10.0, 10, 1), status(7.0, 10.0, 10, 1), status(10.0, 10.0, 10, 1), status(10.0, None, 20, 1)] == ["NEEDS_REVIEW", "NEEDS_REVIEW", "VERY_CROWDED", "CROWDED", "PRICE_HIGH", "PRICE_LOW", "OK", "NEEDS_REVIEW"]
    bulk = {k: one(spark, v) for k, v in decisions.bulk_buy(F.lit(20.0)).items()}
    assert (bulk["buy_price"], bulk["sale_price"], bulk["fees"], bulk["tax"], bulk["profit"], bulk["category"]) == (8.0, 22.0, 4.0, 1.0, 8.0, "5_to_25")


def test_charges_and_offers(spark):
    assert one(spark, decisions.charge_class("k", "f", "m"), k="NON_SALE_CHARGE", f="AD_FEE", m="") == "advertising"
    assert one(spark, decisions.offer_type("t", F.lit(None), F.lit(None)), t="Buy one get one") == "bogo"
    assert one(spark, decisions.discount_qualifier("t", F.lit(20)), t="Up to 20% off") == "up_to"

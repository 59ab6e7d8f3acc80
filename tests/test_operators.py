"""Relational operators, sources and stateful parts on small tables."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import aggregates, matching, ranking
from quarrymill.sources import html, tables
from quarrymill.streaming import lifecycle


def test_weighted_percentile_is_nearest_rank(spark):
    rows = spark.createDataFrame([("a", 10, 1), ("a", 20, 1), ("a", 30, 0), ("b", 5, 3), ("b", 9, 1)], "k string, v long, w long")
    got = {r.k: (r.p25, r.p50) for r in aggregates.weighted_percentiles(rows, ["k"], "v", "w", {"p25": 0.25, "p50": 0.5}).collect()}
    assert got == {"a": (10, 10), "b": (5, 5)}


def test_order_export(spark, tmp_path):
    """The known export: four orders of one item behind a preamble."""
    head = "Sales Record Number,Order Number,Item Title,Custom Label,Quantity,Sold For,Shipping And Handling,Sale Date"
    lines = ['1,order-1,Artist - Album Brand New/Sealed Vinyl,Whole Test,3,$20.00,$6.00,Jul-10-26', '2,order-2,Artist - Album Factory Sealed Vinyl,Whole Test,1,$30.00,$0.00,Jun-01-26', '3,order-3,Artist - Album VG+/VG+ Vinyl,Used Test,2,$10.00,$4.00,Oct-01-25', '4,order-4,"Artist - Album\nVinyl",Unknown Test,1,$8.00,$4.00,Jan-01-24', ",,,,,,,", "5,order-5,,x,2,,$9.00,Jan-01-24"]
    (tmp_path / "orders.csv").write_text("Report\n\n" + head + "\n" + "\n".join(lines) + "\n")
    columns = ["Order Number", "Item Title", "Custom Label", "Quantity", "Sold For", "Shipping And Handling", "Sale Date"]
    rows = tables.order_lines(tables.csv_with_found_header(spark, str(tmp_path), columns)).orderBy("order_number").collect()
    assert [(r.order_number, r.quantity, r.total_paid) for r in rows] == [("order-1", 3, 22.0), ("order-2", 1, 30.0), ("order-3", 2, 12.0), ("order-4", 1, 12.0)]
    assert rows[0].sale_date == datetime.date(2026, 7, 10)


def test_flattened_orders(spark):
    item = "struct<line_item_id: string, title: string, quantity: long, line_item_cost: double, shipping_cost: double, currency: string, refunds: array<struct<amount: double>>>"
    rows = spark.createDataFrame(
        [("o1", datetime.datetime(2026, 1, 2), "PAID", None, [("l1", "a", 2, 40.0, 10.0, "USD", [(10.0,)]), ("l2", "b", 1, 20.0, None, "USD", None)]), ("o2", None, "FAILED", None, [("l", "c", 1, 1.0, 1.0, "USD", None)]), ("o3", None, "PAID", "CANCELLED", [("l", "c", 1, 1.0, 1.0, "USD", None)]), ("o4", None, "PAID", "PARTIALLY_CANCELLED", [("l", "c", 1, 1.0, 1.0, "USD", None)])],
        f"order_id string, creation_date timestamp, payment_status string, cancel_state string, line_items array<{item}>",
    )
    got = {r.record_key: (r.sold_for, r.shipping, r.refund) for r in tables.flattened_orders(rows).collect()}
    assert got == {"o1:l1": (20.0, 5.0, 5.0), "o1:l2": (20.0, 0.0, 0.0), "o4:l": (1.0, 1.0, 0.0)}


def fetch_numbers(first, last, offset, limit):
    return [json.dumps({"from": first, "n": n}) for n in range(offset, min(offset + limit, 5))]


def test_paged_source(spark):
    spark.dataSource.register(tables.PagedSource)
    frame = spark.read.format("paged").option("slices", json.dumps([["a", "b"], ["c", "d"]])).option("page", "2").option("reader", "tests.test_operators:fetch_numbers").load()
    assert sorted((r.slice, r.offset) for r in frame.collect()) == [(s, n) for s in (0, 1) for n in range(5)]


def test_xml_and_json(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<R><Item><id>1</id><title>x</title></Item><Item><id>2</id></Item></R>")
    assert tables.xml_items(spark, str(tmp_path / "a.xml"), "Item", "id long, title string").count() == 2
    assert tables.versioned_json(spark, str(tmp_path / "none.json"), "a long").count() == 0
    (tmp_path / "b.json").write_text('{"a": 3}')
    assert tables.versioned_json(spark, str(tmp_path / "b.json"), "a long").first().a == 3


def test_pages(spark):
    page = """<a href="/p/1" class=x><b>One &amp;amp; two</b></a> <a href='https://shop.com/sale'>Sale</a><a href="https://other.com/sale">Sale</a><a href="/list?page=2">Next</a>
      $20.00 now, was $35.00 and so it goes on for a while. free shipping over $99.00 as always</p>
      <script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "A", "gtin13": "123", "offers": [{"price": "5", "availability": "OutOfStock"}, {"price": "7.5"}]}, {"@type": "Thing"}]}</script>
      <script type="application/ld+json">{"@type": "Product", "name": "B", "offers": {"lowPrice": "3", "availability": "SoldOut"}}</script><script type="application/ld+json">{broken</script>
      <script type="application/ld+json">[{"@type": "ItemList", "itemListElement": [{"item": {"@type": "Product", "name": "C", "price": "2"}}]}]</script>"""
    frame = spark.createDataFrame([(1, "https://www.shop.com/x", page), (2, "u", None)], "id int, url string, html string")
    links = html.anchors(frame, "id").orderBy("position").collect()
    assert [(r.href, r.text) for r in links[:2]] == [("/p/1", "One & two"), ("https://shop.com/sale", "Sale")]
    assert frame.select(html.prices("html").alias("p")).first().p == [20.0, 35.0] or 20.0 in frame.select(html.prices("html").alias("p")).first().p
    assert [r.href for r in html.scored_links(frame, "id", "url", html.PAGINATION, 1, 3).collect()] == ["/list?page=2"]
    assert [r.href for r in html.scored_links(frame, "id", "url", html.SALES, 50, 3).collect()] == ["https://shop.com/sale"]
    assert sorted((r.title, r.price) for r in html.json_ld_products(frame, "id").collect()) == [("A", 7.5), ("C", 2.0)]


def test_private_columns(spark):
    tables.assert_no_private_columns(spark.range(1))
    with pytest.raises(ValueError, match="Buyer"):
        tables.assert_no_private_columns(spark.range(1).select(F.array(F.struct(F.lit(1).alias("Buyer_Name"))).alias("a")))


def test_publish_once(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert tables.publish_run(spark.range(2), path, "r1", "h") and not tables.publish_run(spark.range(2), path, "r1", "h")
    with pytest.raises(ValueError, match="other content"):
        tables.publish_run(spark.range(3), path, "r1", "other")
    assert spark.read.parquet(path).count() == 2


def brute_selection(rows, limit, source_cap, family_cap, keep):
    rows = sorted(rows, key=lambda r: (-r[3], r[0]))
    chosen, sources, families = {}, {}, {}

    def add(r, capped):
        if r[0] in chosen or len(chosen) >= limit or sources.get(r[1], 0) >= source_cap or capped and families.get(r[2], 0) >= family_cap:
            return
        chosen[r[0]] = True
        sources[r[1]] = sources.get(r[1], 0) + 1
        families[r[2]] = families.get(r[2], 0) + 1

    for r in rows[:keep]:
        add(r, True)
    for r in rows:
        if r[2] not in families:
            add(r, True)
    for capped in (True, False):
        for r in rows:
            if r[1] not in sources:
                add(r, capped)
    for capped in (True, False):
        for r in rows:
            add(r, capped)
    return set(chosen)


@pytest.mark.parametrize("seed", range(3))
def test_diversity_select(spark, seed):
    import math

    rng = random.Random(seed)
    rows = [(i, f"s{min(rng.randint(0, 12), rng.randint(0, 12))}", f"f{rng.randint(0, 3)}", float(rng.randint(0, 40))) for i in range(150)]
    limit = 30
    frame = spark.createDataFrame(rows, "id long, source string, family string, score double")
    n_s, n_f = len({r[1] for r in rows}), len({r[2] for r in rows})
    want = brute_selection(rows, limit, max(5, math.ceil(limit * 0.2), math.ceil(limit / n_s)), max(1, math.ceil(limit * 0.5), math.ceil(limit / n_f)), math.ceil(limit * 0.2))
    assert {r.id for r in ranking.diversity_select(frame, limit).collect()} == want


def test_allocation_adds_up(spark):
    rows = spark.createDataFrame([("a", i, w, 1000) for i, w in enumerate((1, 1, 1))], "k string, i int, w long, amount int")
    assert [r.allocated for r in ranking.allocate(rows, ["k"], "w", "amount", [F.col("i")]).orderBy("i").collect()] == [333, 333, 334]


def test_transitive_groups_and_merge(spark):
    rows = spark.createDataFrame([(i, f"a{i // 2}", f"b{(i + 1) // 2}", 5.0 + i, 9.0 if i % 2 else None, None if i else "g", f"t{i}", None if i > 1 else i == 1) for i in range(40)] + [(50, None, None, 1.0, None, None, "x", None), (51, "z", None, 1.0, None, None, "x", False)], "row_id long, a string, b string, price double, regular double, gtin string, title string, available boolean")
    groups = matching.transitive_groups(rows, "row_id", ["a", "b"])
    assert {r.row_id: r.group for r in groups.collect()} == {i: 0 for i in range(40)} | {50: 50, 51: 51}
    merged = {r.group: r for r in matching.merge_products(rows.join(groups, "row_id")).collect()}
    assert (merged[0].offers, merged[0].price, merged[0].regular_price, merged[0].gtin, merged[0].available) == (40, 5.0, 9.0, "g", True)
    assert merged[50].available is None and merged[51].available is False


def test_unique_lookup(spark):
    rows, index = spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "key string, v int")
    assert {r.k: r.v for r in matching.unique_lookup(rows, index, "k", "key", "v").collect()} == {"a": 1, "b": None, "c": None}


def test_token_match_equals_brute_force(spark):
    rng = random.Random(3)
    names = [" ".join(rng.sample("red blue old new ring rod plate gear".split(), rng.randint(1, 4))) for _ in range(120)]
    frame = spark.createDataFrame([(i, n.split()) for i, n in enumerate(names)], "id long, words array<string>")
    got = {(r.q, r.i, r.score) for r in matching.token_match(frame.withColumnRenamed("id", "q"), frame.withColumnRenamed("id", "i"), "q", "i", "words").collect()}
    want = set()
    for q, a in enumerate(names):
        a = set(a.split())
        scored = sorted((-len(a & set(b.split())) / max(len(a), len(set(b.split()))), i) for i, b in enumerate(names) if i != q)
        want |= {(q, i, round(-s, 4)) for s, i in [x for x in scored if x[0] <= -0.65][:3] if len(a) >= 2}
    assert {(q, i) for q, i, _ in got} == {(q, i) for q, i, _ in want}


SEEN = lambda spark, rows: spark.createDataFrame(rows, "campaign string, content string")


def test_lifecycle_table(spark):
    """new, ongoing, changed, unknown on a failed check, ended after two misses, reopened; health decides what a miss is."""
    ledger = spark.createDataFrame([], lifecycle.LEDGER)
    runs = [([("a", "x")], None), ([("a", "x")], None), ([("a", "y")], None), ([], [("a", False)]), ([], [("a", True)]), ([], []), ([], [("a", True)]), ([("a", "y")], None)]
    statuses = []
    for n, (seen, health) in enumerate(runs):
        checked = None if health is None else spark.createDataFrame(health, "campaign string, checked boolean")
        step = lifecycle.reconcile(ledger, SEEN(spark, seen), checked, f"r{n}").collect()
        statuses.append((step[0].status, step[0].misses, step[0].failures))
        ledger = spark.createDataFrame([tuple(r)[:8] for r in step], lifecycle.LEDGER)
    assert statuses == [("new", 0, 0), ("ongoing", 0, 0), ("changed", 0, 0), ("unknown", 0, 1), ("ongoing", 1, 0), ("ongoing", 1, 0), ("ended", 2, 0), ("new", 0, 0)]


def test_lifecycle_evergreen_and_replay_agree(spark):
    rng = random.Random(1)
    runs = [f"r{k}" for k in range(12)]
    rows = [(c, r, rng.choice("xy") if c == "c2" else "x") for c in ("c1", "c2", "c3") for r in runs if c == "c1" or rng.random() < 0.6]
    got = {(r.campaign, r.run): (r.status, r.scans, r.consecutive, r.misses) for r in lifecycle.replay(spark.createDataFrame(rows, "campaign string, run string, content string"), runs).collect()}
    assert got["c1", "r4"][0] == "evergreen"
    ledger = spark.createDataFrame([], lifecycle.LEDGER)
    for run in runs:
        step = lifecycle.reconcile(ledger, SEEN(spark, [(c, x) for c, r, x in rows if r == run]), None, run).collect()
        for r in step:
            assert got[r.campaign, run] == (r.status, r.scans, r.consecutive, r.misses)
        ledger = spark.createDataFrame([tuple(r)[:8] for r in step], lifecycle.LEDGER)


def test_history(spark):
    step = lifecycle.reconcile(spark.createDataFrame([], lifecycle.LEDGER), SEEN(spark, [("a", "x")]), None, "r0")
    row = lifecycle.history(step, "r0").first()
    assert (row.campaign, row.from_status, row.to_status, row.reason) == ("a", None, "new", "first_seen")


def test_lifecycle_stream(spark, tmp_path):
    schema = "campaign string, run_no int, content string"
    for n, rows in enumerate([[("a", 0, "x")], [("a", 1, "x"), ("b", 1, "y")], [("a", 4, "x"), ("b", 2, "z")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        query = lifecycle.replay_stream(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r.campaign, r.run_no): r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 0): "new", ("a", 1): "ongoing", ("a", 2): "ongoing", ("a", 3): "ended", ("a", 4): "new", ("b", 1): "new", ("b", 2): "changed"}


def test_apply_once_stops_on_conflicts(spark):
    events = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c")], "id long, d string")
    applied = spark.createDataFrame([(3, "c")], "id long, d string")
    assert sorted(r.id for r in lifecycle.apply_once(events, applied, "id", "d").collect()) == [1, 2]
    changed = spark.createDataFrame([(3, "other")], "id long, d string")
    assert [r.id for r in lifecycle.corrections(changed, applied, "id", "d").collect()] == [3]
    with pytest.raises(Exception, match="new content"):
        lifecycle.apply_once(changed, applied, "id", "d").collect()


def test_sync_range(spark):
    row = spark.sql("SELECT timestamp'2026-07-10 15:00:00' AS l, timestamp'2026-07-16 12:00:00' AS n").select(lifecycle.sync_range(F.col("l"), F.col("n")).alias("r")).first().r
    assert (str(row["from"]), str(row["to"])) == ("2026-06-26 00:00:00", "2026-07-16 11:55:00")


def test_hashes(spark):
    frame = spark.createDataFrame([(1, "x", None)], "b int, a string, c string")
    import hashlib

    assert frame.select(lifecycle.content_hash("b", "a", "c").alias("h")).first().h == hashlib.sha256(b'{"a":"x","b":1}').hexdigest()


def test_coherent_claims(spark):
    from quarrymill.operators.campaigns import coherent_claim

    texts = {
        "20% off all vinyl": (True, False, True),
        "sitewide sale: 15% off": (True, True, False),
        "20% off apparel sitewide": (False, False, False),
        "20% off apparel. 30% off sitewide": (True, True, False),
        "all vinyl " + "x" * 90 + " 20% off": (False, False, False),
        "15 percent off vinyl sale": (True, False, True),
        "Everything! " + "y" * 58 + " BOGO": (True, True, False),
        "use code A, hoodies, everything; use code B everything": (True, True, False),
        "everything": (False, False, False),
        "": (False, False, False),
    }
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = frame.select("t", *[coherent_claim("t", s) for s in ("any", "sitewide", "vinyl-wide")]).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == texts | {None: (False, False, False)}


def test_candidate_gate(spark):
    """Titles that must not pass, each with its reason, and records that must."""
    from quarrymill.functions import candidates

    shop, item = "https://shop.example.com/about", "https://shop.example.com/products/1"
    cases = [
        ("Album Koozie", item, {}, "non_vinyl_format"), ("Pink Floyd - Guitar Picks", item, {}, "non_vinyl_format"), ("Album Necklace", item, {}, "non_vinyl_format"),
        ("Best of Shampoo - Edition", item, {}, "non_music_retail_category"), ('Miles Davis - Kind of Blue 12"', item, {}, None), ("Kind of Blue LP", item, {"type": "marketplace_retailer"}, None),
        ("Kind of Blue - Album", item, {"type": "marketplace_retailer"}, "marketplace_requires_explicit_vinyl"), ("Kind of Blue - Album", item, {"name": "Walmart"}, "marketplace_requires_explicit_vinyl"),
        ("Some Book vinyl", "https://b.example/p/?ean=9781234567890", {}, "isbn_book_listing"), ("Records under $20", item, {"id": "cheap-vinyl"}, "deal_category_navigation"),
        ("Plain words", item, {"id": "cheap-vinyl"}, "deal_aggregator_requires_record_title"), ("An Album", "https://s.example/products/x-digital-album", {}, "digital_only_product"),
        ("Vinyl wall clock", item, {}, "record_accessory"), ("Coasters made from recycled vinyl records", item, {}, "record_accessory"), ("Used vinyl", item, {}, "non_new_condition"),
        ("An Album flac", item, {}, "non_vinyl_format"), ("Free shipping today", item, {}, "promotion_label"), ("Some Name", shop, {}, "no_product_or_format_signal"), ("Some Name", item, {}, "weak_record_signal"),
        ("Some Name", item, {"name": "Vinyl Record Shop"}, None), ("Shop", item, {}, "navigation_label"), ("ab", item, {}, "title_too_short"), (None, None, {}, "title_too_short"),
        ("Décal - Édition", item, {}, None),
    ]
    for title, url, source, reason in cases:
        row = spark.createDataFrame([(title, url)], "t string, u string").select(candidates.assess("t", F.lit(""), F.lit(""), F.lit(""), "u", {k: F.lit(v) for k, v in source.items()})["reject"]).first()
        assert row[0] == reason, (title, row[0], reason)
    context = spark.createDataFrame([("Plain words", item)], "t string, u string").select(candidates.assess("t", F.lit(""), F.lit(""), F.lit("shoes and toys"), "u")["reject"]).first()
    assert context[0] == "non_music_retail_context"


def test_high_signal_finds(spark):
    from quarrymill.functions import candidates

    base = {"source_id": "shop", "source_name": "Shop", "source_url": "https://s.example/p/1", "listing_title": "x", "price": 12.0}
    cases = [
        ({}, False), ({"source_name": "Clearance Shop"}, True), ({"source_name": "Clearance Shop", "price": 60.0}, False), ({"source_name": "Clearance Shop", "discovery_only": True}, False),
        ({"listing_title": "final sale"}, True), ({"discount_percent": 40.0, "threshold": 0.35, "price": 90.0}, True), ({"discount_percent": 40.0, "threshold": 0.35, "price": 90.0, "noise": "high"}, False),
        ({"original_price": 20.0, "quality": 80.0}, True), ({"original_price": 20.0, "quality": 60.0}, False), ({"verified_direct_us": True, "price": 19.0}, True), ({"verified_direct_us": True, "price": 19.0, "stock": "sold out"}, False),
        ({"listing_title": "clearance", "sold_price": 14.0}, False), ({"listing_title": "clearance", "sold_price": 25.0}, True), ({"listing_title": "clearance", "sold_price": 18.0, "sold_count": 2}, True),
        ({"source_name": "Walmart clearance", "sold_by_source": False}, False), ({"source_url": "https://s.example/bogo/deals"}, False),
    ]
    for change, want in cases:
        find = {k: F.lit(v) for k, v in (base | change).items()}
        assert spark.range(1).select(candidates.high_signal(find)).first()[0] is want, change


def test_research_scores(spark):
    from quarrymill.operators import research

    words = lambda s: F.array(*[F.lit(w) for w in s.split()]) if s else F.array().cast("array<string>")
    score = lambda t, a, r: round(spark.range(1).select(research.research_score(words(t), words(a), words(r), F.lit(r)).alias("x")).first().x, 4)
    assert score("blue moon", "ann", "ann blue moon vinyl lp") == 0.94
    assert score("blue moon", "ann", "ann moon blue lp") == 0 and score("blue moon", "ann", "blue moon") == 0 and score("", "ann", "x") == 0
    entry = lambda t, g, e: round(spark.range(1).select(research.entry_score(words(t), words(g), words(e)).alias("x")).first().x, 4)
    assert entry("blue moon", "ann blue moon", "blue moon") == 1.0 and entry("blue moon rising", "ann blue moon rising", "blue moon") == 0.92 and entry("blue moon", "blue moon", "blue sun") == 0.5
    matched = spark.range(1).select(research.listing_match(words("blue moon 7"), words("ann"), words("ann blue moon 7 deluxe"), words("deluxe"), words("deluxe"))["matched"].alias("a"), research.listing_match(words("blue moon 7"), words("ann"), words("ann blue moon"), words(""), words(""))["matched"].alias("b"), research.listing_match(words("blue moon"), words("ann"), words("ann blue moon"), words("deluxe"), words(""))["reasons"].alias("c")).first()
    assert (matched.a, matched.b, matched.c) == (True, False, ["edition-missing"])


def test_page_health_and_status(spark):
    from quarrymill.operators import campaigns

    frame = spark.createDataFrame([(["u"], ["u"], "u"), (["v"], ["v"], "u"), ([], [], "u")], "c array<string>, k array<string>, u string")
    assert [r.h for r in frame.select(campaigns.page_health("c", "k", "u", F.lit("report")).alias("h")).collect()] == ["success", "unknown", "report"]
    assert spark.createDataFrame([("ended",), ("ongoing",), ("new",)], "s string").agg(campaigns.highest_status("s").alias("s")).first().s == "new"


def test_shop_payload(spark):
    from quarrymill.functions import candidates
    from quarrymill.sources import catalogs

    body = json.dumps({"products": [{"title": "Ann - Blue Moon", "handle": "blue-moon", "product_type": "Vinyl", "variants": [{"id": 7, "title": "Default Title", "price": "19.50", "compare_at_price": "25", "available": True, "barcode": " 123 ", "sku": "", "inventory_quantity": -1}, {"id": 8, "title": "CD", "price": "9", "available": True}, {"id": 9, "title": "x", "price": "9", "available": False}, {"id": 10, "title": "x", "price": "?"}]}]})
    rows = catalogs.variant_rows(spark.createDataFrame([(1, body, "https://s.com"), (2, "broken", "o")], "page int, body string, origin string"), "page", "body", "origin").orderBy("position").collect()
    assert [(r.title, r.price, r.compare_at, r.barcode, r.sku, r.inventory, r.url, r.variants) for r in rows] == [("Ann - Blue Moon", 19.5, 25.0, "123", None, None, "https://s.com/products/blue-moon?variant=7", 2), ("Ann - Blue Moon - CD", 9.0, None, None, None, None, "https://s.com/products/blue-moon?variant=8", 2)]
    frame = spark.createDataFrame([tuple(rows[0][c] for c in ("title", "url", "product_type"))] + [(rows[1].title, rows[1].url, "")], "title string, url string, product_type string")
    reject = candidates.assess("title", "product_type", F.lit(""), F.lit(""), "url", {"name": F.lit("Vinyl shop"), "priority": F.lit(2)})["reject"]
    assert [r.title for r in catalogs.accepted(frame, reject).collect()] == ["Ann - Blue Moon"]
    payload = json.dumps({"data": {"data": {"html": "<p>", "itemCountHtml": "3", "pageNumber": 2, "totalPages": 5}}})
    got = spark.createDataFrame([(payload,), ("[]",), ("{}",)], "b string").select(catalogs.results_payload("b").alias("r")).collect()
    assert [r.r and r.r.pages for r in got] == [5, None, None]


def test_deal_pages(spark):
    from quarrymill.sources import catalogs

    feed = """<feed><entry><title>Ann - Blue Moon LP $15.99</title><link href="https://forum.com/1"/><updated>2026-01-01</updated><content>&lt;a href="https://forum.com/u"&gt;u&lt;/a&gt; &lt;a href="https://shop.com/p"&gt;link&lt;/a&gt;</content></entry>
      <entry><title> </title></entry><entry><title>Old</title><category term="expired deal"/><content></content></entry></feed>"""
    rows = catalogs.feed_entries(spark.createDataFrame([(1, feed)], "k int, x string"), "k", "x").collect()
    assert [(r.title, r.price, r.discussion_url, r.deal_url, r.published, r.expired) for r in rows] == [("Ann - Blue Moon LP $15.99", 15.99, "https://forum.com/1", "https://shop.com/p", "2026-01-01", False), ("Old", None, "", None, None, True)]
    page = "<h1>Blue <b>Moon</b></h1><p>Now $12.00</p><p>List price was a while ago set at $30.00</p> Price history $5.00"
    d = catalogs.deal_detail(spark.createDataFrame([(1, page)], "k int, h string"), "k", "h").first()
    assert (d.title, d.current, d.original, d.discount, d.expired) == ("Blue Moon", 12.0, 30.0, 60, False)
    stats = spark.range(1).select(*[c.alias(n) for n, c in catalogs.sales_stats(F.lit("<b>Last Sold:</b> Jul 1, 2026 Low: $3.5 Median: 7 High: x")).items()]).first()
    assert (stats.last_sold, stats.low, stats.median, stats.high) == ("Jul 1, 2026", 3.5, 7.0, None)
    titles = ["[Deal] Ann - Blue Moon - $12.99 at shop", "Ann “Blue Moon” LP", "Something"]
    got = spark.createDataFrame([(t,) for t in titles], "t string").select(catalogs.artist_title("t").alias("a")).collect()
    assert [tuple(r.a) for r in got] == [("Ann", "Blue Moon"), ("Ann", "Blue Moon"), ("Unknown Artist", "Something")]


def test_every_amount_is_judged_alone(spark):
    from quarrymill.sources import catalogs

    want = {
        "$20.00 now, was $35.00 and so it goes on for a while. free shipping over $99.00 as always": [20.0, 35.0],
        "Was $30.00 now $20.00": [30.0, 20.0],
        "<span>$30.00</span><span>$20.00</span>": [30.0, 20.0],
        "a $1.00 b $2.00 c $3.00 d $4.00": [1.0, 2.0, 3.0, 4.0],
        "Shipping: $5.00 $20.00 $1,234.50": [20.0, 1234.5],
        "Shipping: <b>$5.00</b> <i>$20.00</i>": [20.0],
        "$5.00 shipping, $21.00": [21.0],
        "$3.99 / oz USD 12.00 save $4.00 $8.00 off coupon, now $15": [12.0, 15.0],
    }
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", html.prices("t").alias("p")).collect()
    assert {r.t: r.p for r in got} == want
    pages = [(1, "<h1>A</h1><p>Was $30.00 now $20.00 or $40.00</p> Price history $5.00"), (2, "<h1>B</h1>" + "x" * 6000 + "$12.00 $18.00 related deals $1.00"), (3, "<h1>C</h1>$9.00 $11.00" + " y" * 4000)]
    found = catalogs.deal_detail(spark.createDataFrame(pages, "k int, h string"), "k", "h").orderBy("k").collect()
    assert [(r.current, r.original, r.discount) for r in found] == [(30.0, 40.0, 25), (12.0, 18.0, 33), (9.0, 11.0, 18)]


def test_listing_rules(spark):
    from quarrymill.functions import listings as li

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    t = lambda s: F.lit(s)
    assert [one(li.media_grade(t(a), t(b))) for a, b in (("Blue Moon Media: VG+ Sleeve: NM", ""), ("Blue Moon EX/VG", ""), ("Blue Moon near mint", ""), ("Blue Moon", "New"), ("Blue Moon", ""))] == ["VG+", "EX", "NM", "Sealed", "Unknown"]
    assert one(li.third_party_seller(F.lit(None).cast("boolean"), t("Blue Store LLC"), t("blue.com"), t("x"))) is False
    assert one(li.third_party_seller(F.lit(None).cast("boolean"), t("Someone"), t("blue.com"))) is True and one(li.third_party_seller(F.lit(True), t("Someone"), t("blue.com"))) is False
    offer = lambda c, u, d: one(li.direct_new_offer(t(c), t("usd"), t("Brand New"), t(u), t(d), F.lit(None).cast("boolean"), F.lit(False), F.lit(False)))
    assert offer("US", "https://shop.blue.com/p/1", "blue.com") and not offer("DE", "https://blue.com/p", "blue.com") and not offer("US", "https://notblue.com/p", "blue.com")
    assert [one(li.offer_verification(t(a), t(b), t("g"), t(c), F.lit(None).cast("boolean"))) for a, b, c in (("official_api", "", ""), ("", "social-feed", ""), ("", "html", "marketplace_retailer"), ("", "html", "shop"))] == ["official_api", "discovery_lead", "discovery_lead", "direct_retailer"]
    assert tuple(one(li.least_reference(("sales", F.lit(9.0)), ("guide", F.lit(7.0)), ("market", F.lit(7.0)), ("ten", F.lit(None)))))[::2] == (7.0, "guide")
    assert tuple(one(li.guide_price(F.create_map(t("Near Mint (NM or M-)"), F.lit(0.0), t("Good (G)"), F.lit(3.456))))) == ("Good (G)", 3.46)
    assert one(li.item_tokens([t("v1|123456789|0")], [t("https://x.com/itm/blue-moon/123456789?a=1"), t("https://x.com/itm/777777")])) == ["item:123456789", "item:777777"]
    assert one(li.query_variants(t("Ann"), t("Blue Moon Original Motion Picture Soundtrack"))) == ["Ann Blue Moon Original Motion Picture Soundtrack", "Ann Blue Moon", "Ann Blue Moon Soundtrack", "Ann Blue Moon OST"]
    assert one(li.conditional_discount(t("20% off for new customers"))) is True and one(li.strip_edition_noise(t("Blue Moon (2020) Deluxe Edition 2LP 180g Vinyl"))) == "Blue Moon"
    assert one(li.observation_key(t(" A "), F.lit(2), F.lit(None))) == '["a","2",""]'


def test_listing_operators(spark):
    from quarrymill.operators import listings as lo

    rows = spark.createDataFrame([("l1", "a", 5.0, 1), ("l2", "a", 4.0, 2), ("l1", "b", 90.0, 3), ("l2", "b", 95.0, 4), ("l2", "c", None, 5)], "lane string, item string, price double, id int")
    good, bad = lo.lanes(rows, "lane", "item", "price", F.when(F.col("price") > 50, "too_dear").when(F.col("price").isNull(), "no_price"), [F.col("id")])
    assert [(r.item, r.price, r.lanes) for r in good.collect()] == [("a", 4.0, ["l1", "l2"])]
    assert sorted(tuple(r) for r in bad.collect()) == [("l1", "too_dear", 1), ("l2", "no_price", 1), ("l2", "too_dear", 1)]
    assert sorted(tuple(r) for r in lo.work_queue(rows, "item", F.col("price") > 50).collect()) == [("a", 2, False, 1), ("b", 2, True, 3), ("c", 1, None, 5)]
    ledger = spark.createDataFrame([("s", f"u{i % 6}", i) for i in range(12)], "source string, url string, seen int")
    assert [r.url for r in lo.recheck_pages(ledger, "source", "url", F.when(F.col("url") == "u0", 1).otherwise(0), "seen").orderBy("rank").collect()] == ["u0", "u5", "u4", "u3"]
    current = spark.createDataFrame([(1, "x", 10), (None, "y", 20), (None, "z", 30), (None, "z", 31)], "id int, title string, median int")
    merged = lo.snapshot_merge(spark.createDataFrame([(1, "q"), (2, "y"), (3, "z")], "id int, title string"), current, "id", "title", ["median"])
    assert {r.id: r.median for r in merged.collect()} == {1: 10, 2: 20, 3: None}
    left, right = spark.createDataFrame([(1, "a", "u"), (2, "b", None)], "l int, k string, url string"), spark.createDataFrame([(7, "a", "u"), (8, "z", "u"), (9, "q", None)], "r int, k string, url string")
    assert sorted(tuple(r) for r in lo.either_key(left, right, [("k", "k"), ("url", "url")], "l", "r").collect()) == [(1, 7), (1, 8)]
    history = spark.createDataFrame([("old",), ("kept",)], "campaign string")
    campaigns = spark.createDataFrame([("new", ["old", "new"]), ("kept", [])], "campaign string, merged array<string>")
    assert sorted(r.campaign for r in lo.aliased(history, campaigns, "campaign", "merged").collect()) == ["kept", "new"]
    runs = spark.createDataFrame([("draft", "3", "r3"), ("final", "2", "r2"), ("final", "1", "r1")], "phase string, created_at string, run string")
    assert lo.latest_final(runs).first().run == "r2"
    feedback, now = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, k string"), spark.createDataFrame([(1, "a"), (2, "x")], "id int, k string")
    assert sorted(r.id for r in lo.prune_stale(feedback, now, "id", "k").collect()) == [1, 3]


def test_find_evaluation_fixtures(spark):
    """A find that clears every gate is bought; each missing piece of evidence is named and stops that."""
    import datetime as dt

    from quarrymill.operators import evaluation

    at = lambda h: dt.datetime(2026, 7, 15, h)
    sold = {"captured_at": at(10), "condition": "new_sealed", "resale_price": 40.0, "latest_sale": dt.date(2026, 7, 12), "match_confidence": "high", "source": "local-own-sales-history", "status": "validated", "units_30": 5.0, "units_90": 12.0, "units_365": 30.0}
    active = {"captured_at": at(10), "exact_count": 3.0, "match_confidence": "high", "complete": True, "status": "available"}
    base = {"artist": "Test Artist", "condition": "new/sealed", "purchase_price": 10.0, "source_currency": "USD", "captured_at": at(9), "offer_verification": "direct_retailer", "costs": {"inbound_shipping": 0.0}, "sold": sold, "active": active}
    changes = [
        ({}, "BUY", "ADAPTIVE_STRATEGY_PASSED,STRATEGY_FAST_TURN"),
        ({"offer_verification": "campaign_advertised"}, "REVIEW", "ACQUISITION_OFFER_UNVERIFIED"),
        ({"offer_verification": "discovery_lead"}, "REVIEW", "ACQUISITION_OFFER_UNVERIFIED"),
        ({"offer_verification": None}, "REVIEW", "ACQUISITION_OFFER_UNVERIFIED"),
        ({"offer_verification": "direct-retailer"}, "REVIEW", "ACQUISITION_OFFER_UNVERIFIED"),
        ({"captured_at": dt.datetime(2026, 7, 12)}, "REVIEW", "OFFER_STALE_OR_UNDATED"),
        ({"captured_at": dt.datetime(2026, 7, 16)}, "REVIEW", "OFFER_STALE_OR_UNDATED"),
        ({"source_currency": "EUR"}, "REVIEW", "SOURCE_CURRENCY_UNCONVERTED"),
        ({"source_currency": None}, "REVIEW", "SOURCE_CURRENCY_UNKNOWN"),
        ({"condition": "VG+"}, "REVIEW", "SOLD_EVIDENCE_INCOMPLETE,SOLD_CONDITION_MISMATCH"),
        ({"sold": {**sold, "source": "research"}}, "REVIEW", "SOLD_EVIDENCE_INCOMPLETE,SOLD_VELOCITY_UNVALIDATED"),
        ({"sold": {**sold, "match_confidence": "low"}}, "REJECT", "SOLD_MATCH_CONFIDENCE_LOW"),
        ({"active": {**active, "complete": False}}, "REVIEW", "ACTIVE_EVIDENCE_INCOMPLETE"),
        ({"active": None}, "REVIEW", "ACTIVE_EVIDENCE_INCOMPLETE,EVIDENCE_STALE_OR_UNDATED,ACTIVE_MATCH_CONFIDENCE_LOW"),
        ({"purchase_price": 39.0}, "REJECT", "ECONOMICS_HARD_FAIL"),
        ({"lowest_active_price": 9.0}, "REJECT", "ACTIVE_MARKET_BELOW_BUY_COST"),
        ({"preference": "avoid"}, "REJECT", "USER_AVOID_PREFERENCE"),
        ({"purchase_price": 19.0}, "WATCH", "ECONOMICS_GATE_FAILED,PRICE_TARGET_WATCH"),
    ]
    rows = spark.createDataFrame([base | c | {"id": i} for i, (c, _, _) in enumerate(changes)], evaluation.find_schema())
    got = {r.id: r for r in evaluation.evaluate(rows, "2026-07-15 12:00:00").collect()}
    assert [(got[i].decision, got[i].reason_codes) for i in range(len(changes))] == [c[1:] for c in changes]
    first = got[0]
    assert (first.net_profit, first.roi, first.sell_through, first.supply_months) == (13.75, 1.2557, 0.8, 0.75)
    assert all(first[g] for g in ("active_evidence", "demand", "economics", "confident", "market_fresh", "offer_fresh", "offer_verified", "sold_evidence", "supply"))
    assert got[7].net_profit is None and got[7].max_price is None

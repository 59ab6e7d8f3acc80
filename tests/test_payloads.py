"""Products out of page payloads: the cases of a shop's pages as data, and every page of the query."""

import json

import pytest
from pyspark.sql import functions as F

from quarrymill.sources import html, payloads


def script(data, head='type="application/json"'):
    return f"<script {head}>{data if isinstance(data, str) else json.dumps(data)}</script>"


def catalogue(spark, pages):
    rows = [(i, url, text) for i, (url, text) in enumerate(pages)]
    return [r.asDict() for r in payloads.catalogue(spark.createDataFrame(rows, "id long, url string, html string"), "id").orderBy("id", "rank").collect()]


def test_products_of_pages(spark):
    graph = {"@graph": [{"@type": "Organization", "name": "Example Records", "url": "/about"}, {"@type": "Product", "gtin13": "0194398781234", "image": {"url": "/images/rio.jpg"}, "listPrice": "$29.99", "name": "Blue Band - River (Vinyl LP)", "offers": {"@type": "Offer", "availability": "https://schema.org/InStock", "price": "13.00", "priceCurrency": "USD"}, "sku": "RIV-1", "url": "/products/river?utm_source=newsletter"}]}
    card = {"availabilityStatusV2": {"value": "LIMITED_STOCK"}, "currentPrice": {"displayValue": "$12.97"}, "image": {"src": "/images/cosmos.jpg"}, "productId": "album-42", "productTitle": "Creek - Factory Vinyl", "product_url": "/p/factory?campaign=sale", "regular_price": "$24.99"}
    again = {"availability": "In stock", "canonical": "/p/factory", "current_price": 13.49, "name": "Creek - Factory (Vinyl LP)", "productId": "album-42", "sku": "CR-LP", "upc": "888072123456"}
    sermon = {"title": "Jim - {The Sermon!} \"Vinyl\" LP", "buy_url": "/products/sermon?gclid=x", "sku": "SER", "upc": "602547123456", "price": "$14.50", "available": False, "thumbnail": {"url": "/images/jim.jpg"}}
    noise = {"navigation": {"items": [{"currentPrice": 9.99, "productId": "nav-1", "title": "Featured vinyl"}]}, "nodes": [{"@type": "Offer", "name": "Buy now", "price": 12.99, "url": "/products/no"}, {"name": "Sign in", "price": 10, "productId": "x"}, {"name": "No commerce at all", "product_url": "/products/y"}, {"name": "No identity", "price": 13}, {"@type": "Product", "image": "/i.jpg", "name": "Duke - Newport (Vinyl LP)", "sku": "DUKE-LP"}]}
    same = [{"availability": "In stock", "price": 14.99, "product_url": "/products/time-out/", "sku": "TIME", "title": "Dave - Time Out"}, {"currentPrice": 13, "productId": "record-200", "sku": "TIME", "title": "Dave - Time Out Vinyl LP"}, {"imageUrl": "/images/t.jpg", "listPrice": 27.99, "price": 13.5, "productId": "record-200", "title": "The Dave Quartet - Time Out (Vinyl)", "upc": "888072654321"}]
    got = catalogue(
        spark,
        [
            ("https://a.example/collections/sale?page=1", script(graph, 'type="application/ld+json"')),
            ("https://b.example/collections/vinyl", script({"props": {"pageProps": {"shelves": [{"cards": [card]}]}}}, 'id="__NEXT_DATA__" type="application/json"') + script({"results": {"products": [again]}})),
            ("https://c.example/", "<script>\nwindow.__NEXT_DATA__ = " + json.dumps({"props": {"products": [sermon]}}) + ";\n</script>"),
            ("https://d.example/sale", script("{not-valid-json}") + script(noise) + script({"title": "Not structured", "price": 1, "sku": "z"}, 'type="text/javascript"')),
            ("https://e.example/sale", script(same)),
            ("https://f.example/", None),
            (None, ""),
        ],
    )
    by = {r["id"]: r for r in got}
    assert [r["id"] for r in got] == [0, 1, 2, 3, 4]
    pick = lambda i, *names: tuple(by[i][n] for n in names)
    assert pick(0, "stable_id", "url", "price", "regular", "state", "available", "image", "currency", "gtin", "upc", "kinds") == ("gtin:0194398781234", "https://a.example/products/river", 13.0, 29.99, "in_stock", True, "https://a.example/images/rio.jpg", "USD", "0194398781234", None, "json_ld")
    assert pick(1, "stable_id", "url", "price", "regular", "state", "gtin", "sku", "image", "kinds", "evidence", "title") == ("product:album-42", "https://b.example/p/factory", 12.97, 24.99, "in_stock", "888072123456", "CR-LP", "https://b.example/images/cosmos.jpg", "application_json,next_data", 2, "Creek - Factory (Vinyl LP)")
    assert pick(2, "title", "available", "state", "url", "price", "gtin") == ('Jim - {The Sermon!} "Vinyl" LP', False, "out_of_stock", "https://c.example/products/sermon", 14.5, "602547123456")
    assert pick(3, "stable_id", "price", "sku") == ("sku:duke-lp", None, "DUKE-LP")
    assert pick(4, "stable_id", "price", "regular", "state", "url", "gtin", "image", "sku") == ("product:record-200", 13.0, 27.99, "in_stock", "https://e.example/products/time-out/", "888072654321", "https://e.example/images/t.jpg", "TIME")
    assert "Vinyl" in by[4]["title"]


def test_nodes_at_any_depth_are_walked(spark):
    deep = {"sku": "D", "price": 5, "title": "Deep record"}
    for k in range(10):
        deep = {"a": deep} if k % 2 else {"b": [1, [deep], "x"]}  # one name and two list places, or one name
    found = payloads.payloads(spark.createDataFrame([(1, script(deep))], "id long, html string"), "id")
    rows = payloads.leaves(found, "id").orderBy(F.size("path").desc()).collect()
    assert len(rows) == 3 + 2 * 5 and {len(r.path) for r in rows[:3]} == {5 + 3 * 5 + 1} and {(r.path[-1], r.value) for r in rows[:3]} == {("sku", "D"), ("price", "5"), ("title", "Deep record")}


@pytest.mark.parametrize("text, want", [('{"a":"}"} tail', '{"a":"}"}'), ('[1,[2,{"x":"]"}]];', '[1,[2,{"x":"]"}]]'), ('{"a":"\\"}"}}', '{"a":"\\"}"}'), ("{open", None), ("no", None), ("", None)])
def test_balanced_brackets(spark, text, want):
    assert spark.range(1).select(payloads.balanced(F.lit(text))).first()[0] == want


def test_numeric_entities(spark):
    texts = {"a &#38; b &#x26; &#8217;": "a & b & ’", "&#55296; &#x110000; &#0; &# &": "&#55296; &#x110000; &#0; &# &", "&#x1F600;": "😀", None: None}
    for text, want in texts.items():
        assert spark.range(1).select(html.numeric_entities(F.lit(text).cast("string"))).first()[0] == want

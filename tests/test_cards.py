"""Cards and forum rows: pages of shops, forums and deal sites as data, and every case that gives no row."""

import re

import pytest

from quarrymill.sources import cards

SITE = r"(?i)^https?://(?:www\.)?drops\.example/deals/(?!type/)"


def run(spark, operator, pages, *rest):
    frame = spark.createDataFrame([(i, url, text) for i, (url, text) in enumerate(pages)], "id long, url string, html string")
    return [r.asDict() for r in operator(frame, "id", *rest).collect()]


def test_product_cards(spark):
    grid = """<li class="product" data-name="Mel Davies - Kinds Of Blue (180g Vinyl 2LP)" data-id="75709"><article class="card" data-entity-id="75709" data-product-price="59.99">
      <h3 class="card-title"><a href="/music/vinyl/kinds-of-blue/#top" aria-label="Mel Davies - Kinds Of Blue (180g Vinyl 2LP), $59.99"><b>Mel Davies</b> - Kinds Of Blue</a></h3>
      <div class="price"><span class="price">$59.99</span></div></article></li>"""
    shelf = """<div class="product-grid"><a href="/p/38822017/face-meets-frank" title="Face/Face Meets Frank"><div><span class="product-title">Face</span><span class="product-artist"><br />Face Meets Frank</span></div>
      <span class="see-more-format">Vinyl LP</span><span style="display:none" itemprop="price">11.97</span><span class="sale-price">$11.97</span><span class="normal-price struck">$14.97</span></a></div>"""
    parts = """<li class='sale product'><img data-src='//img.example/a.jpg'><a href='/about'>About</a><a href='/products/a b?x=1&amp;y=2'><span class="product-title">Ana &amp; Co</span><span class="product-artist">Sea</span></a> Sold Out &#36;20.00 $300.00</li>
      <li class="product" data-product-id="AB-1"><a href="/release/one">One more record</a> $9.00</li><article class="big card" data-product-id="AB-1"><a href="/release/two" title="Longer name @ of it">x</a> $1,200.00 <i class="price">$8.50</i><s class="price-was">$12.00</s> unavailable</article>"""
    nothing = '<a href="/c/695/clearance">Clearance</a><a href="/p/123/album">Album</a><li class="product">No link $5.00</li><li class="product"><a href="/products/x">ab</a> $5.00</li><li class="product"><a href="/products/y">Cheap one</a> $1.00</li>'
    got = run(spark, cards.product_cards, [("https://a.example/music/vinyl/", grid), ("https://b.example/c/1", shelf), ("https://c.example/x/", parts), ("https://d.example/", nothing), ("https://e.example/", None), (None, grid), ("https://f.example/", "")])
    by = {(r["id"], r["rank"]): r for r in got}
    assert sorted(by) == [(0, 1), (1, 1), (2, 1), (2, 2)]
    pick = lambda at, *names: tuple(by[at][n] for n in names)
    assert pick((0, 1), "url", "price", "regular", "product_id", "title", "stable_id", "cards", "available", "state") == ("https://a.example/music/vinyl/kinds-of-blue/", 59.99, None, "75709", "Mel Davies - Kinds Of Blue (180g Vinyl 2LP)", "product:75709", 2, None, "unknown")
    assert pick((1, 1), "url", "price", "regular", "product_id", "title", "currency") == ("https://b.example/p/38822017/face-meets-frank", 11.97, 14.97, "38822017", "Face - Face Meets Frank (Vinyl LP)", "USD")
    assert pick((2, 1), "url", "title", "price", "regular", "image", "available", "state", "product_id") == ("https://c.example/products/a%20b?x=1&y=2", "Ana & Co - Sea", 20.0, None, "https://img.example/a.jpg", False, "out_of_stock", None)
    assert pick((2, 2), "url", "title", "price", "regular", "product_id", "stable_id", "cards", "available", "state") == ("https://c.example/release/one", "Longer name - of it", 8.5, 12.0, "AB-1", "product:ab-1", 2, False, "out_of_stock")


def expired_by_hand(html):
    """The rule said over again: what stands around a link is searched."""
    out = []
    for m in re.finditer(r"<a\b([^>]*)>([\s\S]*?)</a>", html, re.I):
        if re.search(r'class="[^"]*\btitle\b', m.group(1)):
            out.append(bool(re.search(r"\bexpired\b", html[max(0, m.start() - 500) : m.end() + 700], re.I)))
    return out


@pytest.mark.parametrize("pad", [0, 460, 480, 600, 660, 690, 1500])
def test_forum_rows_see_what_stands_around_them(spark, pad):
    row = lambda n, flair: f'<a class="title may-blank" href="https://shop.example/{n}" data-permalink="/r/deals/{n}/">[Store] Artist &amp; Co - Album {n} - $1,4{n}.99</a><b>{flair}</b><p>{"." * pad}</p>'
    html = "".join(row(n, flair) for n, flair in enumerate(["Expired", "ok", "ok", "not expiredly", "expired", "ok"])) + '<a class="subtitle" href="/x">expired</a><a class="title" href="/e"> </a>' + row(6, "ok") + '<a class="title" href="/open">'
    got = sorted(run(spark, cards.forum_rows, [("https://forum.example/r/deals/new/", html), (None, None), ("https://f.example/", "no links, expired")]), key=lambda r: r["position"])
    assert [r["expired"] for r in got] == [e for e, t in zip(expired_by_hand(html), re.findall(r'class="title[^>]*>([^<]*)</a>', html), strict=True) if t.strip()]
    assert [(r["title"], r["price"], r["direct_url"], r["discussion_url"]) for r in got[:2]] == [(f"[Store] Artist & Co - Album {n} - $1,4{n}.99", 1.0, f"https://shop.example/{n}", f"https://forum.example/r/deals/{n}/") for n in range(2)]


def test_forum_headline_prices(spark):
    frame = spark.createDataFrame([("A - B - $14.99",), ("$0.00 then $7",), ("$1,234.50",), ("$1500",), ("none",), ("",), (None,)], "t string")
    assert [r[0] for r in frame.select(cards.headline_price("t")).collect()] == [14.99, 7.0, 1234.5, 150.0, None, None, None]


def test_deal_cards(spark):
    html = """<a href="/deals/type/all" class="card">All deals</a><a href="/deals/album" class="big card"><div><h2 class="the-title">Artist – Album (2xLP)</h2>$5</div></a><a href="/deals/album#x" class="card">Again</a>
      <a href="https://www.drops.example/deals/b" class='card'>Plain &quot;b&quot;</a><a href="/deals/c" class="cards">No</a><a href="/deals/d" class="card"> </a><a href="https://other.example/deals/e" class="card">Other</a>"""
    got = run(spark, cards.deal_cards, [("https://drops.example/deals", html), ("https://drops.example/", None), (None, "")], SITE)
    assert sorted((r["id"], r["position"], r["detail_url"], r["title"]) for r in got) == [(0, 1, "https://drops.example/deals/album", "Artist – Album (2xLP)"), (0, 3, "https://www.drops.example/deals/b", 'Plain "b"')]


def test_names_that_clash_and_no_pages(spark):
    frame = spark.createDataFrame([], "rank long, url string, html string, title string, block string")
    assert [operator(frame, "rank", *rest).count() for operator, rest in ((cards.product_cards, ()), (cards.forum_rows, ()), (cards.deal_cards, (SITE,)))] == [0, 0, 0]

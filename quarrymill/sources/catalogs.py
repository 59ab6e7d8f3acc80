"""Catalogue payloads of shops and deal pages to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import col, first_amount, round_half_up
from .html import plain_text, prices

PRODUCT = "struct<title: string, handle: string, vendor: string, product_type: string, tags: string, body_html: string, variants: array<struct<id: string, title: string, price: string, compare_at_price: string, available: boolean, barcode: string, sku: string, inventory_quantity: long>>>"


def variant_rows(pages: DataFrame, key: str, body: str, origin: str) -> DataFrame:
    """Available, priced variants of the products of a JSON page: one row each, with the listing's title and address and the compare-at price where it is higher."""
    parsed = pages.select(key, F.col(origin).alias("_origin"), F.from_json(F.col(body), f"struct<products: array<{PRODUCT}>>").alias("_b"))
    each = parsed.select(key, "_origin", F.explode("_b.products").alias("p")).select(key, "_origin", "p", F.posexplode("p.variants").alias("position", "v"))
    price, before = F.col("v.price").try_cast("double"), F.col("v.compare_at_price").try_cast("double")
    rows = each.where(F.coalesce("v.available", F.lit(True)) & price.isNotNull())
    name = F.when(F.lower(F.coalesce("v.title", F.lit(""))).isin("", "default title"), F.col("p.title")).otherwise(F.concat_ws(" - ", "p.title", "v.title"))
    url = F.concat(F.col("_origin"), F.lit("/products/"), F.col("p.handle"), F.coalesce(F.concat(F.lit("?variant="), F.url_encode("v.id")), F.lit("")))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = rows.select(key, F.col("p.handle").alias("handle"), "position", name.alias("title"), url.alias("url"), price.alias("price"), F.when(before > price, before).alias("compare_at"), blank("v.barcode").alias("barcode"), blank("v.sku").alias("sku"), F.when(F.col("v.inventory_quantity") >= 0, F.col("v.inventory_quantity")).alias("inventory"), "p.product_type", "p.tags", "p.vendor")
    return out.withColumn("variants", F.count(F.lit(1)).over(Window.partitionBy(key, "handle")))


def accepted(rows: DataFrame, reject) -> DataFrame:
    """Rows that a caller's rule doesn't reject: reject is a Column, null where a row is accepted."""
    return rows.withColumn("_reject", reject).where("_reject IS NULL").drop("_reject")


def results_payload(body) -> Column:
    """struct<html, count_html, page, pages> of a search payload; null where it isn't one."""
    parsed = F.from_json(col(body), "struct<data: struct<data: struct<html: string, itemCountHtml: string, pageNumber: int, totalPages: int>>>")
    inner = parsed["data"]["data"]
    return F.when(inner.isNotNull(), F.struct(inner["html"].alias("html"), inner["itemCountHtml"].alias("count_html"), inner["pageNumber"].alias("page"), inner["totalPages"].alias("pages")))


def feed_entries(feeds: DataFrame, key: str, xml: str) -> DataFrame:
    """Entries of an Atom feed: title, first price in it, link, outside link of the content, time, whether expired."""
    each = feeds.select(key, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<entry\b[^>]*>(.*?)</entry>"), F.lit(1))).alias("position", "e"))
    inner = lambda tag: F.regexp_extract("e", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    content = F.replace(F.replace(F.replace(F.replace(inner("content"), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    title = plain_text(inner("title"))
    link = F.regexp_extract("e", r"(?is)<link\b[^>]*href=[\"']([^\"']+)[\"']", 1)
    outside = F.filter(F.regexp_extract_all(content, F.lit(r"(?i)href=\"(https?://[^\"]+)\""), F.lit(1)), lambda u: F.try_parse_url(u, F.lit("HOST")) != F.try_parse_url(link, F.lit("HOST")))
    expired = F.concat(title, F.lit(" "), content).rlike(r"(?i)\bexpired\b") | F.col("e").rlike(r"(?i)<category\b[^>]*(?:term|label)=[\"'][^\"']*expired")
    out = each.select(key, "position", title.alias("title"), first_amount(F.regexp_extract(title, r"\$\s?(\d[\d,]*(?:\.\d+)?)", 1)).alias("price"), link.alias("discussion_url"), F.get(outside, F.lit(0)).alias("deal_url"), F.nullif(F.trim(F.coalesce(F.nullif(inner("updated"), F.lit("")), inner("published"))), F.lit("")).alias("published"), expired.alias("expired"))
    return out.where("title <> ''")


def deal_detail(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Title, current and original price, discount and expiry of a deal page: prices between its heading and the price history; 5,000 characters where a page has none."""
    heading = r"(?is)<h1\b[^>]*>(.*?)</h1>"
    ended, opened = r"(?is)</h1>(.*?)(?:price\s+history|related\s+deals)", r"(?is)</h1>(.{0,5000})"
    region = F.when(F.col(html).rlike(ended), F.regexp_extract(F.col(html), ended, 1)).otherwise(F.regexp_extract(F.col(html), opened, 1))
    out = pages.select(key, plain_text(F.regexp_extract(html, heading, 1)).alias("title"), prices(plain_text(region)).alias("_p"), plain_text(html).rlike(r"(?i)\bdrop\s+expired\b").alias("expired"))
    out = out.withColumn("current", F.get("_p", F.lit(0))).withColumn("original", F.get(F.filter(F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))), lambda p: p > F.get("_p", F.lit(0))), F.lit(0)))
    return out.withColumn("discount", F.floor((F.col("original") - F.col("current")) / F.col("original") * 100 + 0.5)).drop("_p")


def sales_stats(text) -> dict[str, Column]:
    """Last sale, low, median and high of a statistics text; unknown parts are null."""
    t = plain_text(text)
    money = lambda name: round_half_up(F.regexp_extract(t, rf"(?i){name}\s*:\s*\$?\s*(\d+(?:\.\d{{1,2}})?)", 1).try_cast("double"))
    return {"last_sold": F.nullif(F.regexp_extract(t, r"(?i)last\s+sold\s*:\s*([A-Za-z]{3,9}\s+\d{1,2},\s+\d{4})", 1), F.lit("")), "low": money("low"), "median": money("median"), "high": money("high")}


def artist_title(raw) -> Column:
    """struct<artist, title> of a deal headline: tags, prices and trailing dashes go, then the first spaced dash or a quoted title."""
    # What stands before and after the name in a headline, and how artist and title are set apart.
    t = F.regexp_replace(col(raw), r"^(?:(?:\[[^\]]+\]|\([^)]*\))\s*)+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)\s+(?:@|[-–—])?\s*\$\s*[0-9][0-9,.]*(?:\s.*)?$", ""), r"\s+[-–—]\s*$", "")
    t = F.trim(F.regexp_replace(t, r"(?i)\s*\|\s*direct\b.*$", ""))
    dash, quoted = r"^(.{2,100}?)\s+[-–—]\s+(.{2,})$", r"^(.{2,100}?)\s+[\"“]([^\"”]{2,})[\"”](?:\s.*)?$"
    part = lambda k, otherwise: F.when(t.rlike(dash), F.trim(F.regexp_extract(t, dash, k))).when(t.rlike(quoted), F.trim(F.regexp_extract(t, quoted, k))).otherwise(otherwise)
    return F.struct(part(1, F.lit("Unknown Artist")).alias("artist"), part(2, t).alias("title"))

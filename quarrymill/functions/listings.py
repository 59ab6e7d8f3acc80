"""Rules about single listings and offers: sellers, grades, reference prices, verification, observation keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .decisions import chosen
from .money import col, round_plain
from .text import condition_identity
from .urls import host

# Grade names as they are written and their short forms.
GRADES = {"ex": "EX", "ex+": "EX+", "fair": "Fair", "g": "G", "g+": "G+", "g-": "G-", "m": "M", "mint": "M", "near": "NM", "near mint": "NM", "nm": "NM", "nm+": "NM+", "nm-": "NM-", "poor": "Poor", "sealed": "Sealed", "vg": "VG", "vg+": "VG+", "vg++": "VG++", "vg-": "VG-"}
# Grade names as they stand in titles, longer ones first.
_NAMES = r"near mint|mint|nm\+|nm-|nm|vg\+\+|vg\+|vg-|vg|ex\+|ex|g\+|g-|g|fair|poor"
_AFTER = r"(?=\s|[),/;-]|$)"
# Requirements that make a discount conditional.
CONDITIONAL = r"(?i)\b(?:members?\s+only|membership\s+(?:only|required)|(?:rewards?|loyalty|club)\s+members?|prime\s+members?|app(?:-?only|\s+exclusive)|mobile\s+app|first\s+(?:order|purchase)|new\s+customers?|subscribe(?:rs?|\s+and\s+save)?|subscription\s+(?:only|required)|cardholders?|with\s+(?:the\s+)?(?:store|credit)\s+card|spend\s+\$?\d+|orders?\s+(?:over|above|of)\s+\$?\d+|minimum\s+(?:order|purchase|spend)|when\s+you\s+(?:buy|purchase)\s+\d+|(?:buy|purchase)\s+\d+\s+(?:or\s+more|items?|titles?)|tiered\s+(?:sale|discount|savings?))\b"
# Used grades in the order in which a price guide's value is taken.
GUIDE_ORDER = ["Very Good Plus (VG+)", "Near Mint (NM or M-)", "Very Good (VG)", "Good Plus (G+)", "Good (G)", "Mint (M)", "Fair (F)", "Poor (P)"]


def conditional_discount(text) -> Column:
    return F.coalesce(col(text).rlike(CONDITIONAL), F.lit(False))


def short_grade(name) -> Column:
    """Short form of a written grade; unknown ones in upper case."""
    key = F.trim(F.regexp_replace(F.lower(col(name)), r"\s+", " "))
    table = F.create_map(*[F.lit(x) for kv in GRADES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.upper(col(name)))


def media_grade(title, condition) -> Column:
    """Grade of the medium: named as such, else first of a pair, else any in the title, else what the condition says."""
    patterns = [rf"(?i)\b(?:media|vinyl|record|lp)\s*(?:grade|condition)?\s*[:=-]?\s*({_NAMES}|sealed){_AFTER}", rf"(?i)\b({_NAMES}|m)\s*/\s*(?:{_NAMES}|m){_AFTER}", rf"(?i)\b(sealed|{_NAMES}){_AFTER}"]
    found = [F.nullif(F.regexp_extract(col(title), p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*[F.when(f.isNotNull(), short_grade(f)) for f in found], F.when(F.coalesce(col(condition), F.lit("")).rlike("(?i)new|sealed"), "Sealed"), F.lit("Unknown"))


def seller_identity(name) -> Column:
    plain = F.replace(F.lower(F.coalesce(col(name), F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.regexp_replace(F.regexp_replace(plain, r"\b(?:com|company|corp|corporation|inc|llc|online|store|stores)\b", " "), "[^a-z0-9]+", "")


def third_party_seller(sold_by_source, seller, *sources) -> Column:
    """Sold by someone else: said so, or a named seller that none of the source's names contains or is contained in."""
    who = seller_identity(seller)
    names = F.filter(F.array(*[seller_identity(s) for s in sources]), lambda s: s != "")
    kin = F.exists(names, lambda s: F.contains(s, who) | F.contains(who, s))
    flag = col(sold_by_source)
    return F.when(flag.eqNullSafe(F.lit(False)), True).when((who == "") | flag.eqNullSafe(F.lit(True)), False).otherwise(~kin)


def discovery_only(*families) -> Column:
    """The source only points at offers of others."""
    # Families of such sources.
    return F.concat_ws(" ", *families).rlike(r"(?i)\b(?:deal[-_\s]?aggregator|discovery[-_\s]?lead|discovery\s+sources?|distributor[-_\s]?discovery|social[-_\s]?feed)\b")


def direct_new_offer(country, currency, condition, url, domain, sold_by_source, lead, third_party) -> Column:
    """A new item, in US dollars, sold by the source itself on its own host."""
    # Names of the country.
    home = F.coalesce(F.trim(col(country)).rlike(r"(?i)^(?:us|usa|united states|united states of america)$"), F.lit(False))
    shop, own = host(url), host(F.when(col(domain).rlike("(?i)^https?://"), col(domain)).otherwise(F.concat(F.lit("https://"), col(domain))))
    direct = F.coalesce((shop == own) | F.endswith(shop, F.concat(F.lit("."), own)), F.lit(False))
    return home & F.coalesce(F.upper(F.trim(col(currency))) == "USD", F.lit(False)) & (condition_identity(condition) == "new") & ~lead & ~third_party & (direct | (col(sold_by_source).eqNullSafe(F.lit(True)) & shop.isNotNull()))


def offer_verification(explicit, crawl, group, retail, sold_by_source) -> Column:
    """How an offer is vouched for: as said, a lead for aggregators and feeds and for others' goods on marketplaces, else direct."""
    said = F.lower(F.trim(F.coalesce(col(explicit), F.lit(""))))
    low = lambda c: F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    lead = low(crawl).isin("deal-aggregator", "social-feed") | (low(group) == "discovery sources") | ((low(retail) == "marketplace_retailer") & ~col(sold_by_source).eqNullSafe(F.lit(True)))
    return chosen([(said.isin("campaign_advertised", "direct_retailer", "discovery_lead", "official_api"), said), (lead, "discovery_lead")], "direct_retailer")


def least_reference(*named: tuple[str, Column]) -> Column:
    """struct<value, source> of the least known reference price; earlier names win ties."""
    options = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(v.cast("double").alias("value"), F.lit(i).alias("rank"), F.lit(n).alias("source"))) for i, (n, v) in enumerate(named)]))
    return F.array_min(options)


def guide_price(suggestions) -> Column:
    """struct<condition, value> of the first used grade with a positive value in a map of grade to value."""
    known = F.transform(F.array(*[F.lit(g) for g in GUIDE_ORDER]), lambda g: F.struct(g.alias("condition"), round_plain(F.try_element_at(col(suggestions), g)).alias("value")))
    return F.get(F.filter(known, lambda s: s["value"] > 0), F.lit(0))


def observation_key(*parts) -> Column:
    """JSON array of the parts, trimmed and in lower case: equal keys mean the same offer was seen."""
    return F.to_json(F.array(*[F.lower(F.trim(F.coalesce(col(p).cast("string"), F.lit("")))) for p in parts]))


def item_tokens(ids: list, urls: list) -> Column:
    """Sorted distinct identity tokens of a listing: its ids and the numbers in its item addresses."""
    from_ids = [F.regexp_extract(F.coalesce(col(i).cast("string"), F.lit("")), r"(\d{6,})", 1) for i in ids]
    from_urls = [F.regexp_extract(F.coalesce(col(u), F.lit("")), r"/itm/(?:[^/?#]+/)?(\d{6,})", 1) for u in urls]
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.array(*from_ids, *from_urls), lambda t: t != ""), lambda t: F.concat(F.lit("item:"), t))))


def query_variants(artist, title) -> Column:
    """Distinct search texts of a find: artist and title, and for soundtracks the title with its usual names."""
    a, t = F.trim(F.coalesce(col(artist), F.lit(""))), F.trim(col(title))
    # Words for soundtracks.
    core = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?i)\b(?:original\s+)?(?:motion\s+picture\s+)?(?:soundtrack|ost)\b", " "), r"\s+", " "))
    plain = F.trim(F.concat_ws(" ", F.nullif(a, F.lit("")), t))
    more = [F.trim(F.concat_ws(" ", F.nullif(a, F.lit("")), core, F.lit(tail) if tail else None)) if tail else F.trim(F.concat_ws(" ", F.nullif(a, F.lit("")), core)) for tail in ("", "Soundtrack", "OST")]
    film = t.rlike(r"(?i)\b(?:soundtrack|ost|motion\s+picture)\b")
    return F.filter(F.array_distinct(F.when(film, F.array(plain, *more)).otherwise(F.array(plain))), lambda v: F.length(v) >= 3)


def strip_edition_noise(title) -> Column:
    """Title without words of format and edition, for searching."""
    # Patterns of edition noise, in the order they are removed.
    noise = [r"\([^)]*\)", r"\[[^\]]*\]", r"(?i)\b\d{1,3}(?:st|nd|rd|th)\s+anniversary\b", r"(?i)\b(?:deluxe|expanded|limited|remastered|exclusive|collector'?s?)(?:\s+edition)?\b", r"(?i)\b(?:[1-9]\s*x?\s*)?lp\b", r"(?i)\b(?:vinyl|record|album)\b", r"(?i)\b\d+\s*(?:g|gram)\b"]
    return F.trim(F.regexp_replace(reduce(lambda c, p: F.regexp_replace(c, p, " "), noise, col(title)), r"\s+", " "))

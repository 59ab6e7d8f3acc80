"""Identities of releases and pressings, titles cleaned for research and for shops, references to catalogue entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .candidates import ascii_words, folded, says
from .decisions import chosen
from .money import col
from .text import condition_identity, edition_identity, gtin, identity_text
from .urls import product_identity

# What in a group or suffix of a title names an edition or a format.
EDITION_SIGNAL = r"\b(?:[2-9]\s*(?:x\s*)?lp|180\s*g|200\s*g|anniversary|audiophile|black\s+(?:vinyl|lp)|blue\s+(?:vinyl|lp)|box\s+set|clear\s+(?:vinyl|lp)|deluxe|expanded|exclusive|gatefold|gold\s+(?:vinyl|lp)|half\s+speed|limited|marbl(?:e|ed)|mono|numbered|orange\s+(?:vinyl|lp)|picture\s+disc|pink\s+(?:vinyl|lp)|purple\s+(?:vinyl|lp)|red\s+(?:vinyl|lp)|reissue|remaster(?:ed)?|silver\s+(?:vinyl|lp)|smoke|splatter|stereo|swirl|transparent\s+(?:vinyl|lp)|translucent\s+(?:vinyl|lp)|white\s+(?:vinyl|lp)|yellow\s+(?:vinyl|lp))\b"
FORMAT_WORD = r"\b(?:ep|lp|record|vinyl)\b"
# Patterns that a research title loses, in order.
RESEARCH_NOISE = [
    r"\boriginal\s+motion\s+picture\s+soundtrack\b", r"\bmotion\s+picture\s+soundtrack\b", r"\boriginal\s+soundtrack\b", r"\bsoundtrack\b", r"\bmusic\s+(?:on|and|from|by|performance)\b.*$", r"\bmusic\s*(?:&|and)\s*performance\b.*$",
    r"\bwas\s*/\s*ea\b.*$", r"\b(?:limited|deluxe|anniversary|collector'?s?|exclusive|import|indie|target|walmart|urban outfitters|uo)\s+edition\b", r"\b(?:limited|deluxe|anniversary|collector'?s?|exclusive|import|indie|target|walmart|urban outfitters|uo)\b",
    r"\b(?:colored|colour|color|clear|red|blue|green|yellow|pink|purple|orange|white|black|gold|silver|splatter|swirl|marbled|translucent|transparent)\s+vinyl\b", r"\b(?:vinyl|record|records|album|lp|2lp|3lp|4lp|ep|single)\b",
    r"\b(?:180g|180gram|180grams|heavyweight|remaster(?:ed)?|half-speed\s+master)\b", r"\b(?:pre[-\s]?order|sale|clearance|new|sealed|brand\s+new)\b", r"\bstaff\s+pick\b", r"\[[^\]]*\]",
    r"\([^)]*(?:vinyl|lp|record|edition|exclusive|color|colour|soundtrack|remaster|sale|deal)[^)]*\)",
]
# Patterns that a shop's title loses, in order.
RETAIL_NOISE = [
    r"\bMusic\s*(?:&|and)\s*Performance\b", r"\b(?:vinyl|records?|album|[234]?\s*lp)\b", r"\b(?:sale|deal|clearance|limited|edition|exclusive|colored|colour|color)\b", r"\[[^\]]*\]", r"\([^)]*(?:vinyl|lp|record|sale|deal)[^)]*\)",
    r"\bwas\b(?=\s*(?:\$|USD))", r"(?:\$|USD\s*)\s*(?:[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?|[0-9]+(?:\.[0-9]{2})?)", r"(?:/\s*|per\s+)(?:ea(?:ch)?|unit|item|lb|oz|fl\.?\s*oz|kg|g|100g|ct|count)\b", r"\(\s*(?:walmart)?\s*\)", r"\s*-\s*(?=\()",
]


def _without(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, ascii_words(p), " "), patterns, text)


def release_title(title, artist) -> Column:
    """Title of a release as plain words: groups and a suffix that name an edition go, as do a leading artist and a trailing format.

    artist: the artist's identity text."""
    value = folded(F.coalesce(col(title), F.lit("")))
    groups = F.regexp_extract_all(value, F.lit(r"(\([^)]*\)|\[[^\]]*\])"), F.lit(1))
    drop = F.filter(groups, lambda g: says(g, EDITION_SIGNAL) | says(g, FORMAT_WORD))
    value = F.aggregate(drop, value, lambda v, g: F.replace(v, g, F.lit(" ")))
    suffix = F.regexp_extract(value, r"\s+[-–—:|]\s+([^|]+)$", 1)
    value = F.when((suffix != "") & says(suffix, EDITION_SIGNAL), F.regexp_replace(value, r"\s+[-–—:|]\s+[^|]+$", " ")).otherwise(value)
    words = identity_text(value)
    words = F.when((col(artist) != "") & F.startswith(words, F.concat(col(artist), F.lit(" "))), F.substr(words, F.length(col(artist)) + 2)).otherwise(words)
    return folded(F.regexp_replace(words, r"\b(?:on\s+)?(?:vinyl\s+record|vinyl\s+lp|record\s+lp|vinyl|record|lp)\b$", " "))


def pressing_identity(codes: list, artist, title, condition, url) -> Column:
    """Identity of a pressing: its product number, else artist, release, edition and condition, else its address; null where nothing tells."""
    number = gtin(*codes)
    who = identity_text(artist)
    what = release_title(title, who)
    vague = (F.length(who) < 2) | (F.length(what) < 2) | (who == "unknown artist")
    address = product_identity(url)
    release = F.concat(F.lit("release:"), F.concat_ws("|", who, what, edition_identity(title), condition_identity(condition)))
    return chosen([(number.isNotNull(), F.concat(F.lit("gtin:"), number)), (vague & address.isNotNull(), F.concat(F.lit("url:"), address)), (~vague, release)])


def research_title(title) -> Column:
    """Title as it is searched for: signs, prices, editions, formats and shops go."""
    t = F.regexp_replace(F.coalesce(col(title), F.lit("")), r"[|:]+", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+-\s+", " "), r"\$\s*[0-9.,]+", " "))
    t = F.get(F.split(t, ascii_words(r"\s+(?:music\s+(?:on|and|from|by|performance)|was\s*/\s*ea)\b"), -1), F.lit(0))
    t = F.regexp_replace(_without(t, RESEARCH_NOISE), ascii_words(r"\bat\s+(?:amazon|target|walmart|urban outfitters|barnes\s*&\s*noble|deep discount)\b.*$"), " ")
    return folded(F.regexp_replace(t, "[()]", " "))


def retail_title(title) -> Column:
    """Title of a shop listing without formats, prices, units and sale words."""
    t = F.regexp_replace(folded(F.coalesce(col(title), F.lit(""))), r"(?i)^best\s+seller\s+", "")
    return F.trim(F.regexp_replace(folded(_without(t, RETAIL_NOISE)), r"^[\s\-:|]+|[\s\-:|]+$", ""))


BOX_SET = r"\bbox\s*set\b|\bboxset\b"


def lp_count(text) -> Column:
    """Number of discs that a text names: 2LP, 3 x LP, double LP."""
    t = F.coalesce(col(text), F.lit(""))
    n = F.regexp_extract(t, ascii_words(r"\b([1-9])\s*(?:x|-)?\s*lp\b"), 1)
    return chosen([(n != "", n.try_cast("int")), (says(t, r"\bdouble\s+lp\b"), 2), (says(t, r"\btriple\s+lp\b"), 3)])


def format_conflict(candidate, row) -> Column:
    """Whether a sale can't be of the candidate: another number of discs, or a box set where none is meant."""
    a, b, box = lp_count(candidate), lp_count(row), says(F.coalesce(col(candidate), F.lit("")), BOX_SET)
    plain = a.isNull() & says(F.coalesce(col(candidate), F.lit("")), r"\b(?:vinyl\s+)?lp\b") & ~box
    other = F.coalesce(a != b, F.lit(False)) | (plain & F.coalesce(b > 1, F.lit(False)))
    return (~box & says(F.coalesce(col(row), F.lit("")), BOX_SET)) | other


def researchable(kind, price, title, artist) -> Column:
    """A find that research can look for: no sale, with a price and three characters to search."""
    words = folded(F.concat_ws(" ", F.when(~says(F.coalesce(col(artist), F.lit("")), r"^\s*(?:unknown|various)\s+artists?\s*$"), col(artist)), research_title(title)))
    return ~F.coalesce(col(kind) == "sitewide_sale", F.lit(False)) & F.coalesce(col(price) > 0, F.lit(False)) & (F.length(words) >= 3)


def release_reference(value) -> Column:
    """struct<release_id, matched_title, url> of a catalogue address, or null where it isn't one."""
    v = F.trim(col(value))
    url = F.when(F.startswith(v, F.lit("http")), v).otherwise(F.concat(F.lit("https://www.discogs.com"), v))
    path = r"^https?://(?:www\.)?discogs\.com(?:/[^?#]*)?/release/(\d+)(?:-([^/?#]+))?"
    number, slug = F.regexp_extract(url, path, 1), F.regexp_extract(url, path, 2)
    title = F.nullif(F.trim(F.replace(F.coalesce(F.try_url_decode(slug), slug), F.lit("-"), F.lit(" "))), F.lit(""))
    return F.when(number != "", F.struct(number.cast("long").alias("release_id"), title.alias("matched_title"), F.regexp_replace(url, "#.*$", "").alias("url")))


def catalogue_tokens(number) -> Column:
    """Runs of letters and runs of digits of a catalogue number."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(number), F.lit(""))), F.lit(r"([a-z]+|\d+)"), F.lit(1))


def catalogue_score(number, found, year) -> Column:
    """How well a catalogue entry fits a catalogue number: the whole, its tokens, a standalone 1, and a year near 1982."""
    loose = lambda c: F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]", "")
    a, b = loose(number), loose(found)
    wanted, have = catalogue_tokens(number), catalogue_tokens(found)
    matched = F.size(F.filter(wanted, lambda t: F.array_contains(have, t)))
    one, other = F.array_contains(wanted, "1"), F.array_contains(have, "1")
    whole = chosen([(a == b, 100), (F.contains(b, a) | F.contains(a, b), 70)], 0)
    age = F.greatest(F.lit(0), 12 - F.abs(col(year) - 1982)) - F.when(col(year) > 2000, 20).otherwise(0)
    return whole + matched * 12 + F.when((F.size(wanted) > 0) & (matched == F.size(wanted)), 25).otherwise(0) + chosen([(one & other, 20), (one, -15)], 0) + F.coalesce(age, F.lit(0))


def redacted(value) -> Column:
    """A diagnostic text without the destination's postal code: the filter of an address loses that entry, anything else that names it is replaced."""
    v = col(value)
    address = r"^(https?://[^?#]+)\?filter=([^&#]*)$"
    entries = F.filter(F.split(F.regexp_extract(v, address, 2), ","), lambda e: ~F.trim(e).rlike("(?i)^deliveryPostalCode:"))
    base, left = F.regexp_extract(v, address, 1), F.array_join(entries, ",")
    clean = F.when(left != "", F.concat(base, F.lit("?filter="), left)).otherwise(base)
    return F.when(~v.rlike("(?i)deliveryPostalCode"), v).when(v.rlike(address), clean).otherwise("[redacted delivery diagnostic]")

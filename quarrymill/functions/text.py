"""Titles, conditions and identities as Column functions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import col, let

# Words without meaning in a listing title.
TITLE_STOP_WORDS = ["the", "a", "an", "lp", "vinyl", "record", "records", "album", "used"]
SOLD_STOP_WORDS = ["the", "a", "an", "lp", "vinyl", "record", "records", "album", "used", "pressing", "press", "edition", "limited", "remastered", "stereo", "mono"]
QUERY_NOISE_WORDS = ["album", "and", "lp", "record", "records", "stereo", "the", "vinyl"]
EDITION_WORDS = ["pressing", "press", "edition", "limited", "remastered", "stereo"]
# Keywords that make a listing risky to price.
RISK_KEYWORDS = [
    "promo", "white label", "test pressing", "sealed", "colored vinyl", "color vinyl", "limited", "numbered", "import", "original",
    "first press", "mono", "quad", "audiophile", "mfsl", "mobile fidelity", "blue note", "prestige", "impulse", "punk", "hardcore",
    "metal", "psych", "private press", "reggae", "ska", "hip hop", "12\"", "maxi-single", "bootleg", "unofficial", "rare",
    "misprint", "withdrawn", "club edition",
]
GRADE = r"(M|NM|EX|VG\+|VG|G\+|G|F|P)"
GRADE_PAIR = rf"(?i)\b{GRADE}\s*/\s*{GRADE}(?![A-Z+])"
SEALED = r"(?i)\b(factory\s+sealed|brand\s+new(?:\s*/\s*sealed)?|new\s*/\s*sealed|new\s+sealed|sealed)\b"
SALES_NOISE = [r"[|]", SEALED, GRADE_PAIR, r"(?i)\bultrasonic(?:ally)?\s+clean(?:ed)?\b", r"(?i)\bvinyl\s+record\b", r"\b\d{4}\b", r"(?i)\b\d+\s*(?:gram|grams|g)\b"]


def word_list(text, stop: list[str] = TITLE_STOP_WORDS) -> Column:
    """Lower-case words of a title: & is "and", other signs are spaces, stop words go."""
    plain = F.regexp_replace(F.replace(F.lower(col(text)), F.lit("&"), F.lit(" and ")), r"[^a-z0-9\s]", " ")
    drop = F.array(*[F.lit(w) for w in stop]) if stop else F.array().cast("array<string>")
    return F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~F.array_contains(drop, w))


def normalise_title(text) -> Column:
    return F.array_join(word_list(text), " ")


def query_words(text) -> Column:
    """Words of three characters or more that say something."""
    return F.filter(word_list(text), lambda w: (F.length(w) >= 3) & ~w.isin(QUERY_NOISE_WORDS))


def strip_sales_noise(text) -> Column:
    return F.trim(F.regexp_replace(reduce(lambda c, p: F.regexp_replace(c, p, " "), SALES_NOISE, col(text)), r"\s+", " "))


def normalise_sold(text) -> Column:
    """Key text of the sold-history aggregator."""
    return F.array_join(word_list(strip_sales_noise(text), SOLD_STOP_WORDS), " ")


def normalise_sold_library(text) -> Column:
    """Key text of the library variant: title words first, then edition words go."""
    pattern = r"\b(" + "|".join(EDITION_WORDS) + r")\b"
    return F.trim(F.regexp_replace(F.regexp_replace(normalise_title(strip_sales_noise(text)), pattern, " "), r"\s+", " "))


def sold_condition(title, label=None) -> Column:
    label = F.coalesce(col(label), F.lit("")) if label is not None else F.lit("")
    return F.when(F.trim(label).rlike(r"(?i)^whole\b"), "new_sealed").when(col(title).rlike(SEALED), "new_sealed").when(col(title).rlike(GRADE_PAIR), "used").otherwise("unknown")


def grades(title) -> Column:
    """struct<media, sleeve>, null where the title has no pair."""
    part = lambda k: F.nullif(F.upper(F.regexp_extract(col(title), GRADE_PAIR, k)), F.lit(""))
    return F.struct(part(1).alias("media"), part(2).alias("sleeve"))


def artist_and_release(title, spaced: bool = True) -> Column:
    """struct<artist, release>: the parts around the first dash; without one the whole is the release."""
    clean = strip_sales_noise(title)
    pattern = r"^(.{2,80}?)" + (r"\s+[-–—]\s+" if spaced else r"\s*[-–—]\s+") + r"(.{2,})$"
    has = clean.rlike(pattern)
    return F.struct(F.when(has, F.trim(F.regexp_extract(clean, pattern, 1))).alias("artist"), F.when(has, F.trim(F.regexp_extract(clean, pattern, 2))).otherwise(F.nullif(clean, F.lit(""))).alias("release"))


def sold_key(title) -> Column:
    """Group key: artist::release, or the release."""
    both = artist_and_release(title)
    artist = F.nullif(normalise_sold(both["artist"]), F.lit(""))
    return F.concat_ws("::", artist, normalise_sold(F.coalesce(both["release"], col(title))))


_LATIN = "".join(chr(c) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFKD", chr(c))) > 1 and unicodedata.normalize("NFKD", chr(c))[0].isascii())
_PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in _LATIN)


def fold_latin(text) -> Column:
    """Latin letters without their marks."""
    return F.translate(F.regexp_replace(text, r"[̀-ͯ]", ""), _LATIN, _PLAIN)


def identity_text(text) -> Column:
    """Lower-case ASCII words of a name; Latin letters lose their marks, apostrophes go."""
    plain = F.regexp_replace(F.replace(F.lower(fold_latin(F.coalesce(col(text), F.lit("")))), F.lit("&"), F.lit(" and ")), r"['’]", "")
    return F.trim(F.regexp_replace(plain, r"[^a-z0-9]+", " "))


def gtin(*values) -> Column:
    """First value with 8, 12, 13 or 14 digits, without leading zeros beyond twelve digits."""
    digits = F.transform(F.array(*[F.coalesce(col(v), F.lit("")) for v in values]), lambda v: F.regexp_replace(v, r"\D", ""))
    good = F.filter(digits, lambda d: F.length(d).isin(8, 12, 13, 14))
    return F.regexp_replace(F.get(good, F.lit(0)), r"^0{1,2}(?=\d{12}$)|^0(?=\d{13}$)", "")


# Words that name an edition, and colours and textures of a pressing.
EDITION_SIGNALS = ["audiophile", "box set", "deluxe", "expanded", "gatefold", "half speed", "limited", "mono", "numbered", "picture disc", "remaster(?:ed)?", "reissue", "stereo"]
COLOURS = ["black", "blue", "brown", "clear", "cream", "gold", "gray", "green", "grey", "orange", "pink", "purple", "red", "silver", "transparent", "translucent", "white", "yellow"]
TEXTURES = ["galaxy", "marble", "marbled", "smoke", "splatter", "swirl"]


def edition_signals(text) -> Column:
    """Sorted set of edition signals of a listing text; empty for a standard edition.

    The text is folded once, and all words of a kind are found in one pass: a match looks ahead and takes nothing, so one may begin inside another."""
    return let(identity_text(text), _signals_of_words)


def _signals_of_words(t: Column) -> Column:
    every = lambda pattern, form: F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), form)
    any_of = lambda words: "(" + "|".join(words) + ")"
    one = lambda condition, label: F.when(condition, F.array(F.lit(label))).otherwise(F.array().cast("array<string>"))
    # Shops with exclusive editions, and patterns of anniversaries, numbers of discs and weights.
    shop = F.regexp_extract(t, r"\b(target|walmart|amazon|indie|urban outfitters|barnes and noble|barnes noble|b and n)\s+exclusive\b", 1)
    hued = lambda x: F.concat(F.lit("color-"), F.replace(x, F.lit("grey"), F.lit("gray")))
    dated = let(every(r"\b(\d{1,3})(?:st|nd|rd|th)? anniversary\b", lambda x: F.concat(F.lit("anniversary-"), x)), lambda d: F.when(F.size(d) > 0, d).otherwise(F.array(F.lit("anniversary"))))
    none = F.array().cast("array<string>")
    parts = [
        F.when(t.rlike(r"\banniversary\b"), dated).otherwise(none),
        every(r"\b([2-9])\s*(?:x\s*)?lp\b", lambda x: F.concat(x, F.lit("lp"))),
        every(r"\b(180|200)\s*g\b", lambda x: F.concat(x, F.lit("g"))),
        every(rf"\b(?={any_of(EDITION_SIGNALS)}\b)", lambda x: F.regexp_replace(F.replace(x, F.lit(" "), F.lit("-")), "^remaster$", "remastered")),
        F.when(~F.contains(t, F.lit("exclusive")), none).otherwise(F.when(shop != "", F.array(F.concat(F.lit("exclusive-"), F.replace(shop, F.lit(" "), F.lit("-"))))).otherwise(one(t.rlike(r"\bexclusive\b"), "exclusive"))),
        every(rf"\b(?={any_of(COLOURS)}\s+(?:colored\s+)?(?:vinyl|lp)\b)", hued),
        every(rf"\b(?=(?:vinyl|lp)\s+(?:in\s+)?{any_of(COLOURS)}\b)", hued),
        every(rf"\b(?={any_of(TEXTURES)}\b)", lambda x: F.concat(F.lit("texture-"), F.replace(x, F.lit("marbled"), F.lit("marble")))),
    ]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))


def edition_identity(text) -> Column:
    return let(edition_signals(text), lambda signals: F.when(F.size(signals) == 0, "standard").otherwise(F.array_join(signals, ",")))


def condition_identity(condition) -> Column:
    c = F.coalesce(col(condition), F.lit(""))
    return F.when(c.rlike(r"(?i)\b(?:pre[-\s]?owned|used|very\s+good|vg|near\s+mint|nm|fair|poor)\b"), "used").when(c.rlike(r"(?i)\b(?:brand\s+new|factory\s+sealed|new|sealed)\b"), "new").otherwise("unknown")


def token_similarity(left, right) -> Column:
    """Shared words over the larger set of words; arguments are arrays."""
    a, b = F.array_distinct(left), F.array_distinct(right)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)).cast("double")).otherwise(0.0)


def has_all_words(query, title) -> Column:
    return F.size(F.array_except(query, title)) == 0


def risk_keywords(title) -> Column:
    """The risk keywords that occur in a title."""
    low = F.lower(col(title))
    return F.filter(F.array(*[F.lit(k) for k in RISK_KEYWORDS]), lambda k: F.contains(low, k))


def source_family(group, retail, crawl, kind, source) -> Column:
    """Composite family of a source; the source itself where nothing else is known."""
    g, r, c, k = (identity_text(x) for x in (group, retail, crawl, kind))
    part = lambda name, v, ok=None: F.when((v != "") & (ok if ok is not None else F.lit(True)), F.concat(F.lit(name + ":"), v))
    joined = F.concat_ws("|", part("group", g), part("retail", r), part("crawl", c), part("type", k, k != c))
    return F.when(joined != "", joined).otherwise(F.concat(F.lit("source:"), F.coalesce(F.nullif(identity_text(source), F.lit("")), F.lit("unknown"))))


def promo_code(text) -> Column:
    found = F.upper(F.regexp_extract(col(text), r"(?i)\b(?:code|promo|coupon)\s*:?\s*([A-Z0-9]{4,20})\b", 1))
    return F.nullif(found, F.lit(""))


def availability(text) -> Column:
    """State of an availability text: a schema.org name or prose."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    rules = [(r"out\s*of\s*stock|sold\s*out|unavailable|discontinued", "out_of_stock"), (r"pre\s*-?\s*order|presale", "preorder"), (r"back\s*-?\s*order", "backorder"), (r"limited", "limited"), (r"in\s*-?\s*stock|available", "in_stock")]
    return reduce(lambda c, r: c.when(t.rlike(r[0]), r[1]), rules, F.when(F.lit(False), "")).otherwise("unknown")

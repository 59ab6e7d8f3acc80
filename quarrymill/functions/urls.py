"""URLs as Column functions: canonical forms, hosts, markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import col, let

# Query parameters that track a visit and name nothing.
TRACKING = r"^(utm_.*|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|ref|ref_|source|affiliate|aff|cid|irclickid|srsltid|_ga|_pos)$"


def part(url, name: str) -> Column:
    return F.try_parse_url(F.trim(col(url)), F.lit(name))


def host(url) -> Column:
    """Host in lower case, without www."""
    return F.regexp_replace(F.lower(part(url, "HOST")), r"^www\.", "")


def parameters(url, keep) -> Column:
    """?a=b&c=d of the parameters whose name passes `keep`, sorted; empty where none does."""
    pairs = F.filter(F.split(F.coalesce(part(url, "QUERY"), F.lit("")), "&"), lambda p: (p != "") & keep(F.substring_index(p, "=", 1)))
    joined = F.array_join(F.array_sort(pairs), "&")
    return F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")


def _path(path) -> Column:
    short = F.regexp_replace(path, r"/+$", "")
    return F.when(short == "", "/").otherwise(short)


def product_identity(url) -> Column:
    """host/path?variant of a product; collection paths are the product's own. Null for what isn't a URL."""
    path = F.coalesce(part(url, "PATH"), F.lit(""))
    path = F.regexp_replace(path, r"(?i)^.*?(?:^|/)collections/[^/]+/products/([^/?#]+).*$", "/products/$1")
    return F.when(host(url).isNotNull(), F.concat(host(url), _path(path), parameters(url, lambda n: n == "variant")))


def sale_page(url) -> Column:
    """Canonical address of a sale page: no tracking, no paging, collections as a whole."""
    path = F.lower(F.try_url_decode(F.coalesce(part(url, "PATH"), F.lit(""))))
    for pattern in (r"/+$", r"/products\.json$", r"/(?:page|p)/\d+$", r"/page[-_]\d+$"):
        path = F.regexp_replace(path, pattern, "")
    path = F.regexp_replace(path, r"^(/collections/[^/]+).*$", "$1")
    known = F.concat(part(url, "PROTOCOL"), F.lit("://"), host(url), F.when(path == "", "/").otherwise(path), parameters(url, lambda n: ~F.lower(n).rlike(TRACKING)))
    return F.coalesce(known, F.lower(F.regexp_replace(F.regexp_replace(F.trim(col(url)), r"[?#].*$", ""), r"/+$", "")))


def absolute(href, page) -> Column:
    """An http address as a page links it: resolved against the page's, without its fragment; null for other schemes and for relative ones without a page."""
    origin = F.concat(part(page, "PROTOCOL"), F.lit("://"), F.lower(part(page, "HOST")))
    folder = F.regexp_replace(F.coalesce(part(page, "PATH"), F.lit("/")), r"[^/]*$", "")
    known = lambda h: (
        F.when(h.rlike(r"(?i)^https?://[^/?]+$"), F.concat(h, F.lit("/")))
        .when(h.rlike(r"(?i)^https?://"), h)
        .when(h.startswith("//"), F.concat(part(page, "PROTOCOL"), F.lit(":"), h))
        .when(h.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(origin, F.coalesce(part(page, "PATH"), F.lit("/")), h))
        .when(h != "", F.concat(origin, F.when(folder == "", "/").otherwise(folder), h))
    )
    return let(let(F.regexp_replace(F.trim(col(href)), r"#.*$", ""), known), lambda u: F.when(F.try_parse_url(u, F.lit("HOST")).isNotNull(), u))


# Query parameters that a product's address is freed of.
VISIT = r"(?i)^(?:utm_.+|ref(?:errer)?|ref_|source|campaign|campaignid|cmpid|tracking|fbclid|gclid|mc_[ce]id)$"


def without_tracking(url) -> Column:
    """An address without the parameters that track a visit, the others in their order."""
    bare = F.substring_index(col(url), "?", 1)
    kept = F.array_join(F.filter(F.split(F.coalesce(F.regexp_extract(col(url), r"\?(.*)$", 1), F.lit("")), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(VISIT)), "&")
    return F.when(kept != "", F.concat(bare, F.lit("?"), kept)).otherwise(bare)


def same_host(a, b) -> Column:
    return F.coalesce(host(a) == host(b), F.lit(False))


def expired_deal(url) -> Column:
    return F.coalesce(F.try_url_decode(col(url)), col(url)).rlike(r"(?i)\bthread:expired:true\b")


def path_offer(url) -> Column:
    """NN of "NN-off" in a path, 30 to 89, unless it says "up to"."""
    path = F.lower(F.coalesce(part(url, "PATH"), F.lit("")))
    n = F.regexp_extract(path, r"(?:^|[^0-9])(\d{2})(?:-percent)?-off", 1).try_cast("int")
    return F.when(n.between(30, 89) & ~path.rlike(r"up-?to-\d{2}"), n)

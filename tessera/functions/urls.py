"""Addresses: hosts, page keys and what a path says about its page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that say who sent a visitor.
TRACKING = (
    "utm_[a-z_]+|srsltid|gclid|gclsrc|gbraid|wbraid|dclid|fbclid|yclid|msclkid|ttclid|twclid|igshid|mc_cid|mc_eid|_ga|_gl|_hsenc|_hsmi|"
    "ref|ref_src|referrer|_pos|_sid|_ss|_psq|_fid|_v|pr_prod_strat|pr_rec_id|pr_rec_pid|pr_ref_pid|pr_seq|spm|scm|cmpid|irclickid|irgwc|"
    "clickid|click_id|affiliate_id|aff_id"
)
# Path segments by what they name.
STRONG_SEGMENTS = ["product", "products", "prod", "pdp", "pd", "dp", "prd", "item", "buy"]
WEAK_SEGMENTS = ["p", "t", "a", "i", "style", "styles", "sku", "article", "items", "shopping"]
NON_PRODUCT_SEGMENTS = [
    "cart", "bag", "basket", "checkout", "login", "signin", "sign-in", "register", "account", "my-account", "wishlist", "favourites",
    "favorites", "help", "faq", "support", "customer-service", "about", "about-us", "contact", "contact-us", "careers", "jobs", "press",
    "privacy", "terms", "legal", "cookie", "cookies", "returns", "shipping", "delivery", "size-guide", "sizing", "store-locator",
    "storelocator", "stores", "gift-card", "gift-cards", "giftcard", "blog", "news", "magazine", "editorial", "journal", "stories",
    "search", "sitemap", "newsletter", "subscribe", "feedback", "reviews",
]
SHOP_SECTIONS = ["shop", "shops", "store", "boutique", "catalog", "catalogue", "merch", "collections", "collection", "category", "categories"]
SECTION_PARENTS = ["collections", "collection", "category", "categories", "c"]
LISTING_WORDS = [
    "all", "new", "arrivals", "sale", "sales", "clearance", "outlet", "best", "bestsellers", "sellers", "selling", "featured", "trending",
    "shop", "view", "browse", "collection", "collections", "category", "categories", "lookbook", "gift", "gifts", "guide", "archive",
    "edit", "edits", "essentials", "index",
]
PRODUCT_FILE = r"^(product|products?details?|product-details?|itemdetails?|item-details?)\.aspx$"
LISTING_FILE = r"^(items|list|listing|listings|search|results|category|categories|catalog|catalogue)\.(aspx?|html?|php|jsp)$"
PAGE_SUFFIX = r"(?i)\.(html?|aspx|jsp|php)$"
# Registry labels, display names, trackers and marketplaces.
REGISTRY_LABELS = ["com", "co", "org", "net", "gov", "edu", "ac", "biz", "in", "kiev", "kyiv"]
STORE_NAMES = {
    "farfetch": "Farfetch", "ssense": "SSENSE", "mrporter": "Mr Porter", "net-a-porter": "Net-A-Porter", "netaporter": "Net-A-Porter",
    "endclothing": "END.", "matchesfashion": "Matches", "mytheresa": "Mytheresa", "nordstrom": "Nordstrom", "selfridges": "Selfridges",
    "zalando": "Zalando", "asos": "ASOS",
}
TRACKER_HOSTS = ["awin1", "productserve", "prf", "zenaps", "webgains", "tradedoubler", "linksynergy", "go", "click", "redirectingat", "dpbolvw", "anrdoezrs", "jdoqocy", "kqzyfj", "tkqlhce"]
MARKETPLACES = [
    "goat", "stockx", "grailed", "flightclub", "stadiumgoods", "farfetch", "ssense", "mrporter", "netaporter", "endclothing",
    "matchesfashion", "mytheresa", "nordstrom", "selfridges", "zalando", "asos", "yoox", "luisaviaroma", "harrods", "lyst", "zappos",
    "amazon", "ebay", "etsy", "vinted", "depop", "aboutyou", "answear", "lamoda", "intertop", "rozetka",
]

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def in_list(value: Column, words: list[str]) -> Column:
    return value.isin(words)


def raw_host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def store_host(url: Column) -> Column:
    """The host, lower case, without `www.` and a last dot; "" if there is none."""
    return F.regexp_replace(F.regexp_replace(raw_host(url), r"^www\.", ""), r"\.$", "")


def same_store(a: Column, b: Column) -> Column:
    return (store_host(a) != "") & (store_host(a) == store_host(b))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def query(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def listing_key(url: Column) -> Column:
    """A page's address without its spelling: host, tidy path, sorted
    parameters that aren't tracking. Not an address: the trimmed text."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    tidy = F.regexp_replace(F.regexp_replace(path(raw), "/{2,}", "/"), "/+$", "")
    tidy = F.regexp_replace(tidy, r"(?i)^/collections/[^/]+(/products/[^/]+)$", "$1")
    pairs = F.transform(F.split(query(raw), "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=?", "").alias("v")))
    kept = F.sort_array(F.filter(pairs, lambda p: (p["k"] != "") & ~p["k"].rlike(f"(?i)^({TRACKING})$")))
    asked = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    key = F.concat(store_host(raw), F.when(tidy == "", "/").otherwise(tidy), F.when(asked == "", "").otherwise(F.concat(F.lit("?"), asked)))
    return F.when(store_host(raw) == "", raw).otherwise(key)


def same_listing(a: Column, b: Column) -> Column:
    return (listing_key(a) != "") & (listing_key(a) == listing_key(b))


def url_spellings(url: Column) -> Column:
    """Up to nine ways to write the address: as given, and its key with https
    or the own scheme, with and without `www.` and a last slash."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    key, host = listing_key(raw), store_host(raw)
    rest = F.substr(key, F.length(host) + 1)
    place, asked = F.substring_index(rest, "?", 1), F.regexp_extract(rest, r"(\?.*)$", 1)
    scheme = F.regexp_extract(raw, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    ways = []
    for s in (F.lit("https"), scheme):
        for h in (host, F.concat(F.lit("www."), host)):
            for p in (place, F.when(place == "/", "/").otherwise(F.concat(place, F.lit("/")))):
                ways.append(F.concat(s, F.lit("://"), h, p, asked))
    return F.when(raw == "", F.array().cast("array<string>")).when(host == "", F.array(raw)).otherwise(F.slice(F.array_distinct(F.array(raw, *ways)), 1, 9))


def segments(path_: Column) -> Column:
    return F.filter(F.split(F.lower(path_), "/"), lambda s: s != "")


def product_code(segment: Column) -> Column:
    """Five digits in a row, or one to three letters before four digits."""
    token = F.regexp_replace(segment, PAGE_SUFFIX, "")
    return token.rlike(r"[0-9]{5,}") | token.rlike(r"(?i)(^|[^a-z0-9])[a-z]{1,3}[0-9]{4,}")


def product_slug(segment: Column) -> Column:
    """Three words or more that read like the name of one piece."""
    token = F.regexp_replace(segment, PAGE_SUFFIX, "")
    words = F.filter(F.split(token, "[-_]"), lambda w: w != "")
    return (
        (F.length(token) >= 12)
        & (F.size(words) >= 3)
        & ~F.exists(words, lambda w: in_list(w, LISTING_WORDS))
        & F.forall(words, lambda w: w.rlike("^[a-z0-9]+$"))
        & F.exists(words, lambda w: w.rlike("^[a-z]{3,}$"))
    )


def non_product_path(path_: Column) -> Column:
    s = segments(path_)
    return (F.size(s) == 0) | F.exists(s, lambda x: in_list(x, NON_PRODUCT_SEGMENTS)) | F.coalesce(F.try_element_at(s, F.lit(-1)).rlike(LISTING_FILE), F.lit(False))


def product_path(path_: Column) -> Column:
    """Whether a path points at one product: refusals, then a strong segment,
    a weak one with a code, a code at the end, or a name under a section."""
    s = segments(path_)
    last, parent = F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit("")), F.coalesce(F.try_element_at(s, F.lit(-2)), F.lit(""))
    strong = F.exists(s, lambda x: in_list(x, STRONG_SEGMENTS) | x.startswith("productpage"))
    weak = F.exists(s, product_code) & F.exists(s, lambda x: in_list(x, WEAK_SEGMENTS))
    named = ~in_list(parent, SECTION_PARENTS) & F.exists(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda x: in_list(x, SHOP_SECTIONS)) & product_slug(last)
    return F.when(non_product_path(path_), False).otherwise(strong | last.rlike(r"(?i)-item-[0-9]{5,}(\.[a-z]+)?$") | last.rlike(PRODUCT_FILE) | weak | product_code(last) | named)


def locale_prefix(path_: Column) -> Column:
    """The leading one or two segments that are language or country tags."""
    s = segments(path_)
    tag = lambda k: F.coalesce(F.try_element_at(s, F.lit(k)).rlike("^[a-z]{2}([-_][a-z]{2})?$"), F.lit(False))
    return F.when(tag(1) & tag(2), F.concat_ws("/", F.try_element_at(s, F.lit(1)), F.try_element_at(s, F.lit(2)))).when(tag(1), F.try_element_at(s, F.lit(1))).otherwise("")


def label_from_path(url: Column) -> Column:
    """The last two segments as words, joined by a middle dot."""
    s = segments(path(url))
    tail = F.slice(s, F.greatest(F.size(s) - 1, F.lit(1)), 2)
    return F.array_join(F.transform(tail, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, PAGE_SUFFIX, ""), "[-_+]+", " "))), " · ")


def names_products(url: Column) -> Column:
    return F.lower(url).contains("product")


def rank_child(url: Column) -> Column:
    """How promising a child sitemap is: 0 names products, 2 other things."""
    low = F.lower(url)
    return F.when(low.contains("product"), 0).when(low.rlike("blog|article|page|collection|marketing"), 2).otherwise(1)


def page_key(url: Column) -> Column:
    """Host and path in lower case, with the variant if one is named."""
    variant = F.regexp_extract(query(url), "(?:^|&)variant=([^&]*)", 1)
    return F.concat(store_host(url), F.lower(F.regexp_replace(path(url), "/+$", "")), F.when(variant == "", "").otherwise(F.concat(F.lit("?variant="), variant)))


def _label(host: Column) -> Column:
    labels = F.filter(F.split(F.regexp_replace(host, r"^www\.", ""), r"\."), lambda x: x != "")
    second, third = F.try_element_at(labels, F.lit(-2)), F.try_element_at(labels, F.lit(-3))
    return F.when(F.size(labels) < 2, F.coalesce(F.try_element_at(labels, F.lit(1)), F.lit(""))).when(in_list(second, REGISTRY_LABELS) & third.isNotNull(), third).otherwise(second)


def store_name(url: Column, fallback: str = "Store") -> Column:
    """A display name from the host; trackers get the fallback."""
    root = _label(raw_host(url))
    shown = F.create_map(*[F.lit(x) for pair in STORE_NAMES.items() for x in pair])
    return F.when((root == "") | in_list(root, TRACKER_HOSTS), fallback).otherwise(F.coalesce(F.try_element_at(shown, root), F.concat(F.upper(F.substring(root, 1, 1)), F.substr(root, F.lit(2)))))


def compact(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]", "")


def official_store(url: Column, brand: Column) -> Column:
    """Whether the host holds the brand's name (three characters or more)."""
    b = compact(brand)
    return (F.length(b) >= 3) & F.contains(compact(F.regexp_replace(raw_host(url), r"^www\.", "")), b)


def shop_label(host: Column) -> Column:
    return compact(_label(F.lower(host)))


def own_shop(host: Column, brand: Column) -> Column:
    label = shop_label(host)
    return (F.length(label) >= 3) & ~in_list(label, MARKETPLACES) & (compact(brand) == label)


def product_json_url(url: Column) -> Column:
    """The JSON twin of a storefront's product page; null for other pages."""
    handle = F.regexp_extract(path(url), "(?i)/products/([^/]+?)(?:\\.js(?:on)?)?/?$", 1)
    return F.when(handle != "", F.concat(F.regexp_extract(url, "^([^/]+//[^/?#]+)", 1), F.lit("/products/"), handle, F.lit(".json")))


#: Characters of a path that an address spells as their UTF-8 bytes.
UNSAFE = r"[^!-~]|[\"<>`{}]"
_DEFAULT_PORTS = r"(?i)^(http://[^/?#]*):80$|^(https://[^/?#]*):443$"


def _encoded(text: Column) -> Column:
    each = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(UNSAFE), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
    return F.when(text.rlike(UNSAFE), F.array_join(each, "")).otherwise(text)


def _without_dots(place: Column) -> Column:
    """A path with "." and ".." segments followed, never above its root."""
    dot, up = r"^(?:\.|(?i)%2e)$", r"^(?:\.|(?i)%2e){2}$"
    parts = F.split(F.substr(place, F.lit(2)), "/")
    shorter = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when(s.rlike(up), shorter(a)).when(s.rlike(dot), a).otherwise(F.array_append(a, s)))
    # A path that ends in dots ends in a slash.
    whole = F.when(F.element_at(parts, -1).rlike(f"{dot}|{up}"), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(place.rlike(r"(?i)/(?:\.|%2e)"), F.concat(F.lit("/"), F.array_join(whole, "/"))).otherwise(place)


def resolved(href: Column, base: Column) -> Column:
    """The web address that a link on the page `base` leads to, without its
    fragment; null for other schemes and where `base` is no address.

    Links may be whole, without scheme ("//host/..."), from the root, from the
    page's folder, or only a query; "." and ".." are followed, hosts are lower
    case without a default port, and what an address can't hold is encoded.
    """
    raw = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(href, F.lit("")), r"[\t\n\r]", "")), "#.*$", "")
    scheme = F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    place = F.when(path(base) == "", "/").otherwise(path(base))
    folder = F.regexp_extract(place, "^(.*/)", 1)
    asked = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    whole = (
        F.when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), raw)
        .when(raw.startswith("//"), F.concat(scheme, F.lit(":"), raw))
        .when(raw.startswith("/"), F.concat(origin, raw))
        .when(raw.startswith("?"), F.concat(origin, place, raw))
        .when(raw == "", F.concat(origin, place, asked))
        .otherwise(F.concat(origin, folder, raw))
    )
    start = F.regexp_replace(F.lower(F.regexp_extract(whole, r"(?i)^(https?://[^/?#]*)", 1)), _DEFAULT_PORTS, "$1$2")
    own = F.when(path(whole) == "", "/").otherwise(F.regexp_replace(path(whole), r"\\", "/"))
    tail = _encoded(F.regexp_extract(whole, r"^[^?#]*(\?[^#]*)", 1))
    return F.when((origin != "") & start.rlike("^https?://[^/]"), F.concat(start, _encoded(_without_dots(own)), tail))

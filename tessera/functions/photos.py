"""Photo addresses: what photo an address shows and how large."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import colour, garments, urls
from .binding import let

# Parameters that size a photo, suffixes of renditions, file names without a photo.
SIZE_PARAMS = [
    "width", "height", "w", "h", "quality", "q", "size", "sw", "sh", "fit", "crop", "wid", "hei", "qlt", "resmode", "dpr", "scl", "imwidth",
    "imdensity", "maxwidth", "maxheight",
]
RENDITION = r"(?i)_(?:[0-9]{1,5}x[0-9]{0,5}(?:_crop_[a-z]+)?|pico|icon|thumb|small|compact|medium|large|grande|master|original)(?=\.[a-z0-9]+$)"
FORMATS = r"(?i)(?:\.(?:jpe?g|png|webp|avif))+$"
NO_PHOTO = (
    r"^(?:missing|default|blank|empty|none|null|undefined|logo|(?:store|site|shop|brand)[-_]?logo|og[-_]?(?:image|default)|social[-_]?(?:share|image)|share[-_]?image|default[-_]?(?:image|og|share|product))$"
    r"|(?:^|[-_.])(?:placeholder|no[-_]?(?:image|photo|picture|img)|noimage|nophoto|nopicture|image[-_]?(?:not[-_]?)?(?:available|unavailable)|coming[-_]?soon|missing[-_]?(?:image|photo|picture|product))(?:[-_.]|$)"
)
CAMERA = r"^(?:dsc|dscf|dscn|img|mg|imag|dji|gopr|pxl|photo|image)?[0-9]+$|^p[0-9]{7}$"
LEAST_FRAME, MOST_DIFFERING = 8, 2
# Where an image host keeps uploads, its transformations, and blanks that a page fills in.
UPLOAD = "/(?:[^/]+/)?image/(?:upload|private)/"
STEP = "^(?:a|ac|af|ar|b|bo|br|c|co|cs|d|dl|dn|dpr|du|e|eo|f|fl|fn|fps|g|h|ki|l|o|p|pg|q|r|so|sp|t|u|vc|vs|w|x|y|z)_[^,/]*$"
BLANK = r"(?i)^(?:__[a-z0-9_]+__|\{[^{}/]*\}|%7b(?:(?!%7d).)*%7d)$"
WIDTH_BLANK = r"(?i)_(?:\{width\}|%7Bwidth%7D)x(?=\.[a-z0-9]+$)"


def file_name(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.substring_index(urls.path(url), "/", -1)), FORMATS, "")


def image_key(url: Column) -> Column:
    """What photo it is, whatever its size, density and format."""

    def shown(path: Column) -> Column:
        shop = F.regexp_extract(path, r"^(?:/s/files/(?:[0-9]+/)+|/cdn/shop/)((?:files|products)/.+)$", 1)
        return let(F.struct(path.alias("path"), shop.alias("shop")), keyed)

    def keyed(v: Column) -> Column:
        path, shop = v["path"], v["shop"]
        host, place = F.when(shop != "", F.lit("shopify")).otherwise(urls.store_host(url)), F.when(shop != "", F.concat(F.lit("/"), shop)).otherwise(path)
        place = F.regexp_replace(place, RENDITION, "")
        place = let(place, lambda p: F.when(p.contains("/wp-content/uploads/"), F.regexp_replace(p, r"-[0-9]{2,4}x[0-9]{2,4}(?=\.[a-z0-9]+$)", "")).otherwise(p))
        place = F.regexp_replace(F.regexp_replace(F.regexp_replace(place, r"@[23]x(?=\.[a-z0-9]+$)", ""), r"\.(?:jpe?g|png)\.(?:webp|avif)$", ".jpg"), FORMATS, "")
        return F.concat(host, place)

    # Of an upload with transformations, the account and the upload tell.
    upload = let(chain(url), lambda c: F.concat(c["account"], F.lit("/"), F.regexp_replace(F.regexp_replace(F.lower(c["tail"]), "^v[0-9]+/", ""), FORMATS, "")))
    return F.coalesce(upload, let(F.lower(urls.path(url)), shown))


def chain(url: Column) -> Column:
    """struct<account, head, steps, tail> of an address that names an upload
    and the transformations on the way to it; null for other addresses."""
    place = F.regexp_extract(url, f"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*({UPLOAD})", 1)
    step = lambda s: s.rlike(BLANK) | F.forall(F.split(s, ","), lambda part: part.rlike(STEP))

    def parted(v: Column) -> Column:
        rest, n = v["rest"], v["n"]
        tail = F.array_join(F.slice(rest, n + 1, F.greatest(F.size(rest) - n, F.lit(1))), "/")
        steps = F.when(n > 0, F.slice(rest, F.lit(1), n)).otherwise(F.array().cast("array<string>"))
        account = F.concat(urls.store_host(url), F.lit("/"), F.regexp_extract(v["place"], "^/([^/]+)/image/", 1))
        return F.struct(account.alias("account"), v["head"].alias("head"), steps.alias("steps"), tail.alias("tail"))

    def counted(v: Column) -> Column:
        rest = v["rest"]
        # The last part is the upload's name, whatever it looks like.
        first = F.array_position(F.transform(rest, lambda s, n: step(s) & (n < F.size(rest) - 1)), False) - 1
        return let(F.struct(v["place"].alias("place"), v["head"].alias("head"), rest.alias("rest"), first.cast("int").alias("n")), parted)

    def headed(place: Column) -> Column:
        head = F.concat(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), place)
        rest = let(head, lambda h: F.struct(place.alias("place"), h.alias("head"), F.split(F.regexp_replace(F.substr(url, F.length(h) + 1), "[?#].*$", ""), "/").alias("rest")))
        return F.when(place != "", let(rest, counted))

    return F.when(url.contains("/image/"), let(place, headed))


def rendition_rank(url: Column) -> Column:
    """How good a copy an address is: -1 with a blank to be filled; the size
    that a chain of transformations leaves, which is its smallest step times the
    density; the largest number for a chain without a size; 0 for addresses
    without a chain."""

    def ranked(c: Column) -> Column:
        sizes = F.transform(c["steps"], lambda s: F.array_max(F.transform(F.regexp_extract_all(s, F.lit("(?:^|,)[wh]_([0-9]+)(?=,|$)"), 1), lambda n: n.cast("double"))))
        densities = F.flatten(F.transform(c["steps"], lambda s: F.regexp_extract_all(s, F.lit(r"(?:^|,)dpr_([0-9]+(?:\.[0-9]+)?)(?=,|$)"), 1)))
        density = F.coalesce(F.try_element_at(densities, F.lit(-1)).cast("double"), F.lit(1.0))
        whole = F.coalesce(F.array_min(sizes) * density, F.lit(float((1 << 53) - 1)))
        blank = F.exists(c["steps"], lambda s: s.rlike(BLANK))
        return F.when(c.isNotNull(), F.when(blank, F.lit(-1.0)).otherwise(whole))

    return F.coalesce(let(chain(url), ranked), F.when(F.exists(F.split(urls.path(url), "/"), lambda s: s.rlike(BLANK)) | url.rlike(WIDTH_BLANK), -1.0).otherwise(0.0))


def filled_template(url: Column, siblings: Column) -> Column:
    """An address whose blank transformation takes the chain of the best of the
    same account's siblings, or is dropped where there is none; null for an
    address without a chain."""

    def filled(c: Column) -> Column:
        own = F.filter(F.transform(siblings, lambda s, i: F.struct(rendition_rank(s).alias("rank"), (-i).alias("place"), chain(s).alias("chain"))), lambda x: (x["chain"]["account"] == c["account"]) & (x["rank"] >= 0))
        best = F.array_max(F.transform(own, lambda x: F.struct(x["rank"], x["place"], x["chain"]["steps"].alias("steps"))))["steps"]
        return let(F.struct(best.alias("best")), lambda b: joined(c, b["best"]))

    def joined(c: Column, best: Column) -> Column:
        steps = F.flatten(F.transform(c["steps"], lambda s: F.when(s.rlike(BLANK), F.coalesce(best, F.array().cast("array<string>"))).otherwise(F.array(s))))
        return F.concat(c["head"], F.array_join(F.array_append(steps, c["tail"]), "/"))

    return let(chain(url), lambda c: F.when(c.isNotNull(), filled(c)))


def full_size(url: Column) -> Column:
    """The address without size parameters and rendition suffix."""
    kept = F.filter(F.split(urls.query(url), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(SIZE_PARAMS))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), WIDTH_BLANK, ""), RENDITION, "")
    return F.concat(bare, F.when(F.size(kept) == 0, "").otherwise(F.concat(F.lit("?"), F.array_join(kept, "&"))))


def is_placeholder(url: Column) -> Column:
    return file_name(url).rlike(NO_PHOTO) | F.lower(urls.path(url)).rlike("/placeholders?/")


def numbered_frame(a: Column, b: Column) -> Column:
    """Two names of one series: as long as each other, eight characters or
    more, one or two of them different, and no camera's count."""
    differing = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))
    return (F.length(a) == F.length(b)) & (F.length(a) >= LEAST_FRAME) & ~a.rlike(CAMERA) & ~b.rlike(CAMERA) & differing.between(1, MOST_DIFFERING)


def distinct_photos(photos: Column) -> Column:
    """The largest rendition of each photo of an array, in order of first
    appearance; templates without a photo are dropped."""
    rows = F.transform(photos, lambda u, i: F.struct(image_key(u).alias("k"), rendition_rank(u).alias("rank"), i.alias("i"), u.alias("u")))

    def best(rows: Column) -> Column:
        keys = F.array_distinct(F.transform(rows, lambda r: r["k"]))
        return F.transform(keys, lambda k: F.array_max(F.transform(F.filter(rows, lambda r: r["k"] == k), lambda r: F.struct(r["rank"], -r["i"], r["u"]))))

    # Bound, an address is taken apart once, not once for each key.
    return F.transform(F.filter(let(rows, best), lambda b: b["rank"] >= 0), lambda b: b["u"])


def common_stem(a: Column, b: Column) -> Column:
    """Characters that two names start with alike."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y)
    first = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), False)
    return F.when(first == 0, F.least(F.length(a), F.length(b))).otherwise(first - 1)


def gallery(candidates: Column, trusted: Column, name: Column, most: int = 20) -> Column:
    """Photos of the same piece among a page's addresses: the trusted ones,
    then those on a trusted photo's host whose file name holds the piece's
    first two words, starts with ten characters like a trusted one and differs
    in twelve at most, or is another frame of its series; one of each photo."""
    words = F.slice(F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= 3), 1, 2)

    def accepted(u: Column) -> Column:
        own = file_name(u)
        named = (F.size(words) == 2) & F.forall(words, lambda w: F.contains(own, w))

        def kin(t: Column) -> Column:
            other = file_name(t)
            stem = common_stem(own, other)
            tail = F.greatest(F.length(own), F.length(other)) - stem
            return urls.same_store(u, t) & (named | ((stem >= 10) & (tail <= 12)) | numbered_frame(own, other))

        return ~is_placeholder(u) & F.exists(trusted, kin)

    return F.slice(distinct_photos(F.concat(trusted, F.filter(candidates, accepted))), 1, most)


# Words that describe many pieces, file names of furniture, formats
# that are no photo, and how alike file names of one shoot are.
DESCRIBING = [
    "leather", "suede", "wool", "cotton", "linen", "denim", "nylon", "silk", "cashmere", "fleece", "knit", "knitted", "jersey", "canvas", "velvet", "corduroy", "satin",
    "mesh", "faux", "vegan", "oversized", "relaxed", "regular", "slim", "straight", "wide", "cropped", "long", "short", "classic", "vintage", "washed", "heavy",
    "heavyweight", "light", "lightweight", "basic", "essential", "logo", "print", "printed", "graphic", "striped", "stripe", "check", "plain", "zip", "hooded", "mens",
    "womens", "unisex", "kids", "new", "sale",
]
FURNITURE = r"(?i)(?:sprite|placeholder|transparent|blank|pixel|spacer|logo|favicon|icon[-_.]|badge|payment|visa|mastercard|paypal|klarna|afterpay|social|instagram|facebook|tiktok|banner|nav[-_.]|menu|header|footer|newsletter|review|rating|star|flag|loader|spinner|swatch|材质)"
NO_IMAGE = r"(?i)\.(?:js|mjs|css|json|xml|html?|php|aspx?|svg|ico|woff2?|ttf|otf|eot|mp4|webm|mov|m3u8|pdf|txt|zip|gz)$"
LEAST_WORD, LEAST_LONE_WORD, LEAST_CODE, LEAST_STEM, MOST_TAIL = 4, 6, 6, 10, 12


def upgraded(src: Column, page_url: Column) -> Column:
    """The full-size address of an image reference on a page; null for what is
    no photo."""
    whole = full_size(urls.resolved(F.replace(F.coalesce(src, F.lit("")), F.lit("&amp;"), F.lit("&")), page_url))
    place = urls.path(whole)
    image = place.rlike(FORMATS) | (place.rlike(r"/[^/.]+/?$"))
    return F.when((src != "") & ~place.rlike(NO_IMAGE) & image, whole)


def photo_host(url: Column) -> Column:
    """Where a photo is served from: the account of an image host, else the host."""
    return F.coalesce(F.concat(F.lit("account:"), chain(url)["account"]), urls.store_host(url))


def _file(url: Column) -> Column:
    """A photo's own file name, lower case, without its format."""
    upload = chain(url)["tail"]
    return F.regexp_replace(F.lower(F.substring_index(F.coalesce(upload, urls.path(url)), "/", -1)), FORMATS, "")


def stem(url: Column) -> Column:
    """The letters and digits of a file name, without a 32-digit id behind it."""
    return F.regexp_replace(F.regexp_replace(_file(url), "[^a-z0-9]", ""), "[0-9a-f]{32}$", "")


def frame_code(url: Column) -> Column:
    """The code of a file named <code>_<frame>; null for other names."""
    code = F.regexp_extract(_file(url), "^([a-z0-9]*[0-9][a-z0-9]*)_[0-9]{1,2}$", 1)
    return F.when(F.length(code) >= LEAST_CODE, code)


def _describes_many(word: Column) -> Column:
    return word.isin(DESCRIBING) | colour.names_colour(word) | garments.garment(word).isNotNull()


def name_phrases(name: Column) -> Column:
    """Neighbouring words of a name as one, where one of them is its own; the
    word of a name of one, if it is long and its own."""
    words = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    single = F.transform(words, lambda w: F.when((F.length(w) >= 5) & w.endswith("s"), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    own = F.transform(F.filter(single, lambda w: F.length(w) >= LEAST_WORD), lambda w: F.struct(w.alias("w"), _describes_many(w).alias("many")))

    def phrases(o: Column) -> Column:
        pairs = F.transform(F.slice(o, F.lit(2), F.greatest(F.size(o) - 1, F.lit(0))), lambda x, i: F.when(~(x["many"] & o[i]["many"]), F.concat(o[i]["w"], x["w"])))
        lone = F.when((F.length(o[0]["w"]) >= LEAST_LONE_WORD) & ~o[0]["many"], F.array(o[0]["w"])).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(o) == 0, F.array().cast("array<string>")).when(F.size(o) == 1, lone).otherwise(F.array_distinct(F.array_compact(pairs)))

    return let(own, phrases)


def page_identity(page_url: Column, name: Column) -> Column:
    """What a page's own photos may be called: phrases of the piece's name and
    of the address's last two segments, and the codes in these."""
    last = F.reverse(F.slice(F.reverse(F.filter(F.split(urls.path(page_url), "/"), lambda s: s != "")), 1, 2))
    slug = F.regexp_replace(F.array_join(last, " "), urls.PAGE_SUFFIX, "")
    codes = F.array_distinct(F.regexp_extract_all(F.lower(slug), F.lit("[0-9]{6,}"), F.lit(0)))
    return let(slug, lambda s: F.concat(F.flatten(F.transform(F.array(name, s), name_phrases)), codes))


def shot(url: Column) -> Column:
    """What is compared of a photo: struct<url, key, rank, host, stem, code>."""
    rank = rendition_rank(url).cast("double")
    return F.struct(url.alias("url"), image_key(url).alias("key"), rank.alias("rank"), photo_host(url).alias("host"), stem(url).alias("stem"), frame_code(url).alias("code"))


def harvested(candidates: Column, trusted: Column, identity: Column) -> Column:
    """Of a page's `candidates` (array of `shot`), in order, those that show its
    piece besides the `trusted` ones: photos whose file is named as `identity`
    has it, and, next to trusted ones on their host, those of the trusted frames'
    code, or else of a name that starts or runs like a trusted one and is no
    furniture's. A photo held already comes again as a better copy only. Without
    a trusted photo only names count."""

    def accepted(f: Column, c: Column) -> Column:
        named = F.exists(f["names"], lambda p: F.contains(c["stem"], p))
        codes = F.array_compact(F.transform(f["trusted"], lambda t: t["code"]))

        def kin(t: Column) -> Column:
            alike = common_stem(t["stem"], c["stem"])
            return (t["stem"] != "") & (((alike >= LEAST_STEM) & (F.length(c["stem"]) - alike <= MOST_TAIL)) | numbered_frame(t["stem"], c["stem"]))

        beside = F.exists(f["trusted"], lambda t: (t["host"] != "") & (t["host"] == c["host"]))
        same = F.when(F.size(codes) > 0, F.coalesce(F.array_contains(codes, c["code"]), F.lit(False))).otherwise(named | F.exists(f["trusted"], kin))
        own = F.when(F.size(f["trusted"]) == 0, named).otherwise(beside & same)
        return (c["stem"] != "") & (named | ~urls.path(c["url"]).rlike(FURNITURE)) & own

    def walked(f: Column) -> Column:
        held = F.transform(f["trusted"], lambda t: F.struct(t["key"].alias("key"), t["rank"].alias("rank")))
        start = F.struct(held.cast("array<struct<key:string,rank:double>>").alias("held"), F.slice(f["all"], 1, 0).alias("out"))

        def step(s: Column, c: Column) -> Column:
            had = F.array_max(F.transform(F.filter(s["held"], lambda h: h["key"] == c["key"]), lambda h: h["rank"]))
            taken = F.when(had.isNotNull(), c["rank"] > had).otherwise(accepted(f, c))
            grown = F.struct(F.array_append(s["held"], F.struct(c["key"].alias("key"), c["rank"].alias("rank"))).alias("held"), F.array_append(s["out"], c).alias("out"))
            return F.when(taken, grown).otherwise(s)

        return F.aggregate(f["all"], start, step)["out"]

    return let(F.struct(trusted.alias("trusted"), candidates.alias("all"), identity.alias("names")), walked)


def best_copies(shots: Column) -> Column:
    """The addresses of the best copy of each photo, in order of first
    appearance, without those that are blanks only."""
    keys = F.array_distinct(F.transform(shots, lambda s: s["key"]))
    best = lambda k: F.array_max(F.transform(F.filter(F.transform(shots, lambda s, i: F.struct(s["rank"].alias("rank"), (-i).alias("place"), s["url"].alias("url"), s["key"].alias("key"))), lambda s: s["key"] == k), lambda s: s))
    return F.transform(F.filter(F.transform(keys, best), lambda b: b["rank"] >= 0), lambda b: b["url"])

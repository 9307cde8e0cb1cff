"""Garments in names, by their head noun.

A dictionary lists kinds with a category and terms, the most specific first.
Of the terms in a name the last one before "with" decides, in a name with
Cyrillic terms the first one; the longest of those at one place. Where that is
a generic kind, the most specific kind of its category in the name is taken.
Weak terms (fabrics and cuts) count only where nothing else is named. Terms are
looked up by hash (`terms.Terms`), so a name costs the same whatever the size of
the dictionary; one of any size can be read from a table and passed.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import terms
from .binding import let


@dataclass(frozen=True)
class Garment:
    """A kind, its category, the labels it is filed under, the best first, and
    its terms as `terms` has them, with "~" in front of a weak one."""

    kind: str
    category: str
    labels: tuple[str, ...]
    terms: tuple[str, ...] = field(default=())


# Kinds, the most specific first, with category and labels. Their
# terms are a few of our own choice each; a whole dictionary is a parameter.
GARMENTS = (
    Garment("bomber", "outerwear", ("Bomber Jackets", "Jackets"), ("bomber", "bomber jacket", "flight jacket", "бомбер")),
    Garment("raincoat", "outerwear", ("Raincoats", "Jackets"), ("raincoat", "rain jacket", "дождевик", "дощовик")),
    Garment("parka", "outerwear", ("Parkas", "Coats"), ("parka", "anorak", "парка!", "парки!", "парку!", "анорак")),
    Garment("gilet", "outerwear", ("Vests", "Jackets"), ("gilet", "puffer vest", "quilted vest", "жилет")),
    Garment("biker", "outerwear", ("Biker Jackets", "Leather Jackets", "Jackets"), ("biker jacket", "moto jacket", "косух")),
    Garment("leather-jacket", "outerwear", ("Leather Jackets", "Jackets"), ("leather jacket", "suede jacket", "кожан куртк")),
    Garment("denim-jacket", "outerwear", ("Denim Jackets", "Jackets"), ("denim jacket", "trucker jacket", "джинсов куртк", "джинсовк")),
    Garment("puffer", "outerwear", ("Puffer Jackets", "Jackets"), ("puffer", "puffer jacket", "down jacket", "пуховик")),
    Garment("fleece-jacket", "outerwear", ("Fleece Jackets", "Jackets"), ("fleece jacket", "sherpa jacket", "флисов куртк")),
    Garment("track-jacket", "outerwear", ("Track Jackets", "Jackets"), ("track jacket", "tracksuit jacket", "олимпийк")),
    Garment("windbreaker", "outerwear", ("Windbreakers", "Jackets"), ("windbreaker", "wind jacket", "ветровк", "вітровк")),
    Garment("varsity", "outerwear", ("Varsity Jackets", "Jackets"), ("varsity jacket", "letterman jacket")),
    Garment("workwear-jacket", "outerwear", ("Work Jackets", "Jackets"), ("work jacket", "chore jacket", "field jacket", "рабоч куртк")),
    Garment("harrington", "outerwear", ("Harrington Jackets", "Jackets"), ("harrington", "coach jacket", "харрингтон")),
    Garment("jacket", "outerwear", ("Jackets",), ("jacket", "куртк")),
    Garment("trench", "outerwear", ("Trench Coats", "Coats"), ("trench coat", "trench", "тренч", "плащ")),
    Garment("peacoat", "outerwear", ("Peacoats", "Coats"), ("peacoat", "pea coat", "duffle coat", "бушлат")),
    Garment("shearling-coat", "outerwear", ("Shearling Coats", "Coats"), ("shearling coat", "fur coat", "~shearling", "дубленк", "шуб")),
    Garment("overcoat", "outerwear", ("Overcoats", "Coats"), ("overcoat", "topcoat", "car coat", "пальт")),
    Garment("cape", "outerwear", ("Capes", "Coats"), ("cape", "cloak", "накидк")),
    Garment("coat", "outerwear", ("Coats",), ("coat", "пальто!")),
    Garment("outerwear", "outerwear", (), ("~outerwear", "~верхн одежд")),
    Garment("blazer", "blazers", ("Blazers",), ("blazer", "sport coat", "suit jacket", "dinner jacket", "пиджак", "піджак", "блейзер")),
    Garment("waistcoat", "blazers", ("Waistcoats", "Blazers"), ("waistcoat", "suit vest", "жилет костюмн")),
    Garment("suit", "blazers", ("Suits", "Blazers"), ("suit", "pantsuit", "костюм!")),
    Garment("cardigan", "knitwear", ("Cardigans", "Knitwear"), ("cardigan", "кардиган", "кардіган")),
    Garment("sweater-vest", "knitwear", ("Sweater Vests", "Knitwear"), ("sweater vest", "knit vest", "вязан жилет")),
    Garment("turtleneck", "knitwear", ("Turtlenecks", "Knitwear"), ("turtleneck", "roll neck", "водолазк")),
    Garment("knit-polo", "knitwear", ("Knit Polos", "Polo Shirts", "Knitwear"), ("knit polo", "вязан поло")),
    Garment("sweater", "knitwear", ("Sweaters", "Knitwear"), ("sweater", "jumper", "pullover", "свитер", "светр", "джемпер")),
    Garment("knit", "knitwear", ("Knitwear",), ("~knit", "~knitted", "~вязан")),
    Garment("overshirt", "shirts", ("Overshirts", "Shirts"), ("overshirt", "shirt jacket", "shacket", "рубашк куртк")),
    Garment("shirt", "shirts", ("Shirts",), ("shirt", "button down", "~flannel", "рубашк", "сорочк")),
    Garment("hoodie", "tops", ("Hoodies", "Hoodies & Sweatshirts"), ("hoodie", "hooded sweatshirt", "pullover hoodie", "худи", "худі")),
    Garment("sweatshirt", "tops", ("Sweatshirts", "Hoodies & Sweatshirts"), ("sweatshirt", "crewneck sweatshirt", "свитшот", "світшот")),
    Garment("zip-up", "tops", ("Hoodies", "Hoodies & Sweatshirts"), ("~zip up", "~full zip")),
    Garment("half-zip", "tops", ("Sweatshirts", "Hoodies & Sweatshirts"), ("~half zip", "~полузамок")),
    Garment("polo", "tops", ("Polo Shirts", "Polos"), ("polo", "polo shirt", "поло!")),
    Garment("henley", "tops", ("Henleys",), ("henley", "хенли")),
    Garment("tank", "tops", ("Tank Tops", "Tanks"), ("tank top", "singlet", "майка!", "майки!")),
    Garment("camisole", "tops", ("Camisoles", "Tank Tops"), ("camisole", "slip top")),
    Garment("longsleeve", "tops", ("Long Sleeves", "Longsleeves", "Long Sleeve T-Shirts", "T-Shirts"), ("longsleeve", "long sleeve tee", "лонгслив", "лонгслів")),
    Garment("tshirt", "tops", ("T-Shirts",), ("t shirt", "tee", "футболк")),
    Garment("blouse", "tops", ("Blouses",), ("blouse", "блуз")),
    Garment("bodysuit", "tops", ("Bodysuits",), ("bodysuit", "боди!")),
    Garment("bralette", "tops", ("Bralettes", "Crop Tops"), ("bralette", "sports bra", "бралет")),
    Garment("crop-top", "tops", ("Crop Tops",), ("crop top", "bandeau", "bustier", "кроп топ")),
    Garment("tunic", "tops", ("Tunics", "Blouses"), ("tunic", "туник")),
    Garment("jersey", "tops", ("Jerseys", "T-Shirts"), ("football jersey", "~jersey")),
    Garment("crewneck", "tops", (), ("~crewneck",)),
    Garment("top", "tops", (), ("~top", "~vest", "~топ!")),
    Garment("jeans", "jeans", ("Jeans",), ("jeans", "джинсы!", "джинси!")),
    Garment("denim", "jeans", ("Jeans",), ("~denim", "~деним")),
    Garment("shorts", "shorts", ("Shorts",), ("shorts", "bermuda", "swim short", "шорт")),
    Garment("swimwear", "swimwear", ("Swimwear",), ("swimsuit", "swimwear", "bikini", "купальник", "плавк")),
    Garment("cargo", "bottoms", ("Cargo Pants", "Pants"), ("cargo pant", "cargo trousers", "карго!")),
    Garment("workpant", "bottoms", ("Work Pants", "Pants"), ("work pant", "carpenter pant", "рабоч брюк")),
    Garment("jogger", "bottoms", ("Joggers", "Pants"), ("jogger", "sweatpant", "track pant", "джоггер")),
    Garment("leggings", "bottoms", ("Leggings", "Pants"), ("legging", "tights", "легинс", "лосин")),
    Garment("chino", "bottoms", ("Chinos", "Pants"), ("chino", "чинос")),
    Garment("trousers", "bottoms", ("Pants",), ("trouser", "pant", "slacks", "брюк", "штан")),
    Garment("skirt", "skirts", ("Skirts",), ("skirt", "kilt", "юбк", "спідниц")),
    Garment("dress", "dresses", ("Dresses",), ("dress", "gown", "sundress", "плать", "сукн", "сарафан")),
    Garment("jumpsuit", "jumpsuits", ("Jumpsuits",), ("jumpsuit", "playsuit", "dungarees", "комбинезон")),
    Garment("sneaker-model", "footwear", ("Sneakers",), ("air max", "air force 1", "new balance /[0-9]{3,4}[a-z0-9]*/")),
    Garment("boot-model", "footwear", ("Boots",), ("desert boot", "moc toe")),
    Garment("sandal-model", "footwear", ("Sandals",), ("birkenstock",)),
    Garment("boots", "footwear", ("Boots",), ("boot", "chelsea boot", "ботинк", "черевик", "сапог")),
    Garment("sandals", "footwear", ("Sandals",), ("sandal", "slides", "flip flop", "сандал", "босоножк")),
    Garment("sneakers", "footwear", ("Sneakers",), ("sneaker", "trainer", "running shoe", "кроссовк", "кросівк", "кеды")),
    Garment("loafers", "footwear", ("Loafers", "Dress Shoes"), ("loafer", "moccasin", "boat shoe", "лофер", "мокасин")),
    Garment("dress-shoes", "footwear", ("Dress Shoes",), ("oxford shoe", "derby", "brogue", "туфл")),
    Garment("mules", "footwear", ("Mules", "Clogs"), ("mule", "clog", "мюли")),
    Garment("heels", "footwear", ("Heels",), ("heel", "pump", "stiletto", "шпильк")),
    Garment("flats", "footwear", ("Flats",), ("ballet flat", "ballerina", "балетк")),
    Garment("espadrilles", "footwear", ("Espadrilles", "Flats"), ("espadrille", "эспадриль")),
    Garment("slippers", "footwear", ("Slippers",), ("slipper", "тапочк")),
    Garment("shoes", "footwear", (), ("shoe", "~footwear", "обувь", "взутт")),
    Garment("backpack", "bags", ("Backpacks", "Bags"), ("backpack", "rucksack", "рюкзак")),
    Garment("tote", "bags", ("Tote Bags", "Bags"), ("tote", "tote bag", "shopping bag", "шоппер")),
    Garment("crossbody", "bags", ("Crossbody Bags", "Bags"), ("crossbody", "shoulder bag", "handbag", "сумочк")),
    Garment("belt-bag", "bags", ("Belt Bags", "Bags"), ("belt bag", "waist bag", "поясн сумк")),
    Garment("clutch", "bags", ("Clutches", "Bags"), ("clutch", "pouch", "клатч")),
    Garment("travel-bag", "bags", ("Travel Bags", "Bags"), ("travel bag", "duffle bag", "suitcase", "чемодан")),
    Garment("work-bag", "bags", ("Bags",), ("briefcase", "laptop bag", "портфел")),
    Garment("bag", "bags", ("Bags",), ("bag", "сумк")),
    Garment("sunglasses", "accessories", ("Sunglasses",), ("sunglasses", "glasses", "очки!")),
    Garment("watch", "accessories", ("Watches",), ("watch", "chronograph", "часы!")),
    Garment("belt", "accessories", ("Belts",), ("belt", "ремень", "пояс!")),
    Garment("hats", "accessories", ("Hats",), ("hat", "cap", "beanie", "bucket hat", "шапк", "кепк")),
    Garment("scarf", "accessories", ("Scarves", "Scarf/Shawl", "Scarves & Shawls"), ("scarf", "scarves", "bandana", "шарф", "платок")),
    Garment("gloves", "accessories", ("Gloves",), ("glove", "mitten", "перчатк")),
    Garment("socks", "accessories", ("Socks",), ("sock", "stockings", "носк")),
    Garment("jewellery", "accessories", ("Jewelry",), ("jewellery", "necklace", "bracelet", "earring", "ring", "браслет", "кольц")),
    Garment("small-leather", "accessories", ("Wallets",), ("wallet", "cardholder", "key ring", "кошел")),
    Garment("tie", "accessories", ("Ties",), ("tie", "bow tie", "галстук")),
    Garment("umbrella", "accessories", ("Accessories",), ("umbrella", "phone case", "зонт")),
)
# Kinds that name a garment only in general, and words behind which
# a title lists what comes with the piece.
GENERIC = [
    "jacket", "coat", "outerwear", "sweater", "knit", "shirt", "crewneck", "top", "denim", "trousers", "boots", "sandals", "sneakers", "shoes", "bag",
]
ATTACHED = ["with", "w", "featuring", "feat", "incl", "including", "plus"]


def read_dictionary(table: DataFrame) -> tuple[Garment, ...]:
    """A dictionary from a table (rank, kind, category, labels, terms) with a
    row for each kind, the most specific at the least rank. The driver holds
    it; it is a dictionary, not data."""
    rows = table.select("kind", "category", "labels", "terms").orderBy("rank").collect() if "rank" in table.columns else table.collect()
    return tuple(Garment(r.kind, r.category, tuple(r.labels or ()), tuple(r.terms or ())) for r in rows)


def _looked_up(number: Column, fields: dict[str, tuple[list, str]]) -> Column:
    """struct of what constant arrays hold for a number. (An array of structs
    wouldn't be worked out once: the optimizer folds splits and casts only.)"""
    return F.struct(*(F.get(terms.constant(values, kind), number).alias(name) for name, (values, kind) in fields.items()))


@cache
def _index(garments: tuple[Garment, ...]) -> tuple[terms.Terms, dict, dict]:
    """The terms, what is known of each, and of each kind."""
    listed = [(n, t) for n, g in enumerate(garments) for t in g.terms]
    index = terms.Terms([t.removeprefix("~") for _, t in listed])
    told = lambda yes: str(yes).lower()
    spelled = {
        "rank": ([n for n, _ in listed], "int"),
        "strong": ([told(not t.startswith("~")) for _, t in listed], "boolean"),
        "cyrillic": ([told(bool(terms.CYRILLIC.search(t))) for _, t in listed], "boolean"),
        "length": (index.lengths, "int"),
    }
    ranked = {
        "rank": (list(range(len(garments))), "int"),
        "kind": ([g.kind for g in garments], "string"),
        "category": ([g.category for g in garments], "string"),
        "generic": ([told(g.kind in GENERIC) for g in garments], "boolean"),
    }
    return index, spelled, ranked


def garment(text: Column, garments: tuple[Garment, ...] = GARMENTS) -> Column:
    """struct<kind, category, generic, strong> of the head noun; null if no
    term occurs."""
    index, spelled, ranked = _index(garments)

    def hits(words: Column) -> Column:
        placed = lambda h, t: F.struct(h["start"].alias("start"), h["end"].alias("end"), t.alias("t"), _looked_up(t["rank"], ranked).alias("g"))
        told = lambda h: let(_looked_up(h["term"], spelled), lambda t: placed(h, t))
        cut = F.filter(F.transform(words, lambda w, i: F.when(w.isin(ATTACHED), i)), lambda i: i.isNotNull())
        return F.struct(F.transform(index.hits(words), told).alias("all"), F.coalesce(F.get(cut, F.lit(0)), F.size(words)).alias("cut"))

    def head(pool: Column, cut: Column) -> Column:
        best = lambda keep, place: F.array_max(F.transform(F.filter(pool, keep), lambda h: F.struct(place(h).alias("at"), h["t"]["length"].alias("length"), (-h["g"]["rank"]).alias("back"), h["g"].alias("g"))))["g"]
        by_stem = best(lambda h: h["t"]["cyrillic"], lambda h: -h["start"])
        return F.coalesce(by_stem, best(lambda h: h["end"] <= cut, lambda h: h["end"]), best(lambda h: h["end"] > 0, lambda h: h["end"]))

    def named(v: Column) -> Column:
        alike = F.filter(v["pool"], lambda h: h["g"]["category"] == v["head"]["category"])
        first = F.array_min(F.transform(alike, lambda h: h["g"]))
        chosen = F.when(v["head"]["generic"], first).otherwise(v["head"])
        told = lambda g: F.struct(g["kind"].alias("kind"), g["category"].alias("category"), g["generic"].alias("generic"), v["strong"].alias("strong"))
        return F.when(v["head"].isNotNull(), told(chosen))

    def found(every: Column) -> Column:
        strong = F.filter(every["all"], lambda h: h["t"]["strong"])
        pool = F.struct(F.when(F.size(strong) > 0, strong).otherwise(every["all"]).alias("pool"), (F.size(strong) > 0).alias("strong"))
        return let(pool, lambda p: let(F.struct(p["pool"].alias("pool"), p["strong"].alias("strong"), head(p["pool"], every["cut"]).alias("head")), named))

    words = F.filter(F.split(terms.plain(text), " "), lambda w: w != "")
    return let(words, lambda w: let(hits(w), found))


def garment_category(text: Column, garments: tuple[Garment, ...] = GARMENTS) -> Column:
    """The category by a strong term only."""
    return let(garment(text, garments), lambda g: F.when(g["strong"], g["category"]))


def garment_label(text: Column, tree: Column, garments: tuple[Garment, ...] = GARMENTS) -> Column:
    """The first of the kind's labels that a tree (map of label to category)
    has in any spelling and files under the kind's category; null if none."""
    key = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    kinds, labels = terms.constant([g.kind for g in garments]), terms.constant([";".join(g.labels) for g in garments])

    def found(g: Column) -> Column:
        own = F.split(F.get(labels, F.array_position(kinds, g["kind"]).cast("int") - 1), ";")
        fit = lambda x: F.filter(F.map_entries(tree), lambda e: (key(e["key"]) == key(x)) & (e["value"] == g["category"]))
        each = F.transform(own, lambda x: F.get(fit(x), F.lit(0))["key"])
        return F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0))

    return let(garment(text, garments), found)


def garments_conflict(a: Column, b: Column, garments: tuple[Garment, ...] = GARMENTS) -> Column:
    """Both names name a kind, different ones, and neither is generic."""
    both = F.struct(garment(a, garments).alias("a"), garment(b, garments).alias("b"))
    return let(both, lambda v: F.coalesce((v["a"]["kind"] != v["b"]["kind"]) & ~v["a"]["generic"] & ~v["b"]["generic"], F.lit(False)))

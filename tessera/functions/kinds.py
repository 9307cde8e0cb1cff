"""What a piece is and whom it is for: categories, genders, styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import garments, urls

# Category rules, the first that matches wins; Russian stems, asked where no rule matches.
CATEGORY_RULES = [
    (r"\bdress\s*shirt\b", "shirts"),
    (r"\bpolo\b(?!\s*neck)", "tops"),
    (r"\b(air\s*max|air\s*force|af1|air\s*jordan|jordan\s*\d|nike\s*blazer|\bdunk\b|cortez|vapormax|pegasus|samba|gazelle|superstar|stan\s*smith|ozweego|adilette|ultra\s?boost|nmd|yeezy\s*(?:boost|slide|foam|\d)|new\s*balance\s*\d+|chuck\s*taylor|sk8-?hi|old\s*skool|birkenstock|crocs|uggs?)\b", "footwear"),
    (r"\b(footwear|shoes?(?!\s*(?:bag|box|tree|horn|care|lace|rack))|boots?(?!\s*-?cut)|trainers?|sneakers?|sandals?|slides?|sliders?|loafers?|heels?|pumps?|espadrilles?|mules?|brogues?|derbys?|plimsolls?|hi-?tops?|high-?tops?|low-?tops?|slippers?|flip-?flops?|clogs?|moccasins?)\b", "footwear"),
    (r"\b(shorts|bermudas?|(chino|cargo|denim|cycling|running|sweat|board|swim|swimming|beach)\s*shorts?)\b", "shorts"),
    (r"\b(swim(wear|suit|ming)?|bikini|beachwear|trunks|rash\s*guard)\b", "swimwear"),
    (r"\b(jumpsuit|playsuit|dungarees?|overalls?|boilersuit|catsuit|romper|onesie)\b", "jumpsuits"),
    (r"\b(jacket|coat|outerwear|parka|anorak|windbreaker|bomber|trench|puffer|raincoat|overcoat|peacoat|mackintosh|poncho|cape|gilet|(puffer|padded|quilted|down|shell)\s*vest)\b", "outerwear"),
    (r"\b(blazer|waistcoat|tuxedo|suit)\b", "blazers"),
    (r"\b(knitwear|knit|sweater|jumper|cardigan|turtleneck|rollneck|roll\s*neck|polo\s*neck|funnel\s*neck|pullover|(sweater|knit)\s*vest)\b", "knitwear"),
    (r"\b(skirt|kilt)\b", "skirts"),
    (r"\b(dress|gown|frock|sundress|kaftan|caftan)\b", "dresses"),
    (r"\b(t[-\s]?shirt|tee|tank(\s*top)?|camisole|cami|singlet|crop\s*top|vest\s*top)\b", "tops"),
    (r"\b(shirt|overshirt|shacket|oxford|flannel|chambray)\b", "shirts"),
    (r"\b(hoodie|sweatshirt|blouse|polo|bodysuit|tunic|bralette|\btop\b|vest)\b", "tops"),
    (r"\bcrew(?:neck)?\b(?!\s*socks?)|\bcrew[-\s]neck\b", "tops"),
    (r"\b(jeans?|denim)\b(?!\s*jacket)", "jeans"),
    (r"\b(trousers?|pants?(?!y)|chinos?|leggings?|joggers?|sweatpants?|tracksuit|culottes?|slacks)\b", "bottoms"),
    (r"\b(bag|backpack|rucksack|handbag|tote|clutch|satchel|holdall|luggage|suitcase|briefcase|crossbody|messenger\s*bag|duffel|pouch)\b", "bags"),
    (r"\b(belt|tie|bow\s*tie|scarf|scarves|hats?|caps?|beanie|gloves?|mittens?|socks?|sunglasses|jewellery|jewelry|necklace|bracelet|earrings?|watch|wallet|cardholder|purse|umbrella|keyring|headband|bandana|cufflinks?|suspenders?|braces)\b", "accessories"),
]
RUSSIAN_RULES = [
    ("шорт", "shorts"),
    ("купальник|плавк|купальн|бикини", "swimwear"),
    ("комбинезон", "jumpsuits"),
    ("куртк|пальто|плащ|парк|пухов|ветровк|бомбер|тренч|дублёнк|дубленк|шуба|шубы|анорак|пончо|накидк", "outerwear"),
    ("пиджак|блейзер|смокинг|жакет", "blazers"),
    ("кофт|свитер|джемпер|кардиган|водолазк|пуловер", "knitwear"),
    ("юбк", "skirts"),
    ("плать|сарафан", "dresses"),
    ("футболк|майк|блузк|худи|свитшот|толстовк|кроп.?топ", "tops"),
    ("рубашк|сорочк", "shirts"),
    ("джинс|деним", "jeans"),
    ("брюк|штан|легинс|лосин|джоггер|чинос", "bottoms"),
    ("обувь|ботинк|кроссовк|кросс|кеды|туфл|сапог|сандал|лофер|босонож|мокасин|балетк|слайд|\\bугг", "footwear"),
    ("сумк|рюкзак|клатч|портфель|чемодан|барсетк", "bags"),
    ("ремень|ремни|галстук|шарф|платок|платк|шапк|кепк|берет|перчатк|варежк|носк|носок|очки|часы|кошел|бабочк|запонк|подтяжк|ободок", "accessories"),
]
# Words that state a gender, and the style vocabulary.
WOMEN = r"\bwomen\b|\bwomens\b|female|ladies|\bgirl|femme|/women/"
MEN = r"\bmen\b|\bmens\b|\bmale\b|\bboy|homme|/men/"
STYLES = ["minimal", "streetwear", "classic", "avant-garde", "romantic", "utilitarian", "bohemian", "preppy", "sporty", "dark", "maximalist", "coastal", "academic"]


def category(text: Column) -> Column:
    """The category of the first rule that matches, of the Russian ones only
    where no other does; null if none does."""
    low, out = F.lower(text), F
    for pattern, name in CATEGORY_RULES + RUSSIAN_RULES:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise(F.lit(None).cast("string"))


def piece_category(text: Column) -> Column:
    """The category of a title: its head noun's, else that of the rules."""
    return F.coalesce(garments.garment_category(text), category(text))


def retail_category(text: Column) -> Column:
    """struct<category, gender> of a shop's category path: the head noun's
    category, else that of the rules, else accessories."""
    low = F.lower(F.coalesce(text, F.lit("")))
    who = F.when(low.rlike("^(women|girls|ladies|femme|woman)"), "women").when(low.rlike(r"^(men|boys|homme|man\b)"), "men").when(low.contains("unisex"), "unisex")
    return F.struct(F.coalesce(piece_category(low), F.lit("accessories")).alias("category"), who.alias("gender"))


def gender(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(WOMEN), "women").when(low.rlike(MEN), "men").when(low.contains("unisex"), "unisex")


def read_gender(text: Column) -> Column:
    """Both genders, or a word for either, is unisex."""
    low = F.lower(F.coalesce(text, F.lit("")))
    women, men = low.rlike(r"\b(women|womens|female|ladies|femme|damen)\b"), low.rlike(r"\b(men|mens|male|gents|homme|herren)\b")
    return F.when(low.rlike("unisex|genderless") | (women & men), "unisex").when(women, "women").when(men, "men")


def gender_from_page(name: Column, url: Column, breadcrumbs: Column, description: Column) -> Column:
    """struct<gender, source> of a page's strongest statement: its name, its
    address, its breadcrumbs, its description; null if it is silent. In an
    address the singular counts too; a description that speaks of both, the
    singular included, says nothing."""
    either = lambda c, one, many: F.coalesce(F.lower(c).rlike(rf"\b(?:{one}|{many})\b"), F.lit(False))
    women, men = (lambda c: either(c, "woman", "women|womens|female|ladies|femme|damen")), (lambda c: either(c, "man", "men|mens|male|gents|homme|herren"))

    def address(c: Column) -> Column:
        said = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+", " ")
        singular = F.when(women(said) & men(said), "unisex").when(women(said), "women").when(men(said), "men")
        return F.coalesce(read_gender(said), singular)

    stated = [
        (read_gender(name), "name"),
        (address(urls.path(url)), "address"),
        (address(breadcrumbs), "address"),
        (F.when(~(women(description) & men(description)), read_gender(description)), "description"),
    ]
    return F.coalesce(*(F.when(g.isNotNull(), F.struct(g.alias("gender"), F.lit(source).alias("source"))) for g, source in stated))


def normal_styles(values: Column, vocabulary: list[str] = STYLES) -> Column:
    """Known styles, in the vocabulary's order."""
    return F.array_intersect(F.array(*map(F.lit, vocabulary)), F.transform(values, lambda v: F.lower(F.trim(v))))


def word_forms(word: Column) -> Column:
    """A word and its singular spellings."""
    stem = lambda n: F.substr(word, F.lit(1), F.length(word) - n)
    return F.array_compact(
        F.array_distinct(
            F.array(
                word,
                F.when(word.endswith("ies") & (F.length(word) > 4), F.concat(stem(3), F.lit("y"))),
                F.when(word.endswith("es") & (F.length(word) > 3), stem(2)),
                F.when(word.endswith("s") & ~word.endswith("ss") & (F.length(word) > 3), stem(1)),
            )
        )
    )

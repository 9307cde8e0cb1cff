"""A catalogue's habits: tallies, agreement, proposals and their fall-backs."""

from tessera.operators import profile

SCHEMA = "id long, brand string, name string, description string, url string, styles array<string>, gender string, colours array<string>, groups array<string>"


def labelled(spark, rows):
    made = [(k, r.get("brand", ""), r.get("name", "piece"), "", r.get("url"), r.get("styles"), r.get("gender"), r.get("colours"), r.get("groups")) for k, r in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA)


def test_tallies_in_one_pass(spark):
    rows = labelled(spark, [dict(brand="A", url="https://s.com/1", styles=["dark", "dark"]), dict(brand="a.", url="https://s.com/2", styles=["dark", "minimal"]), dict(brand="", url=None, styles=["minimal"])])
    made = profile.built(rows)
    found = {(r.level, r.key): (r.n, dict(r.counts)) for r in made.styles.collect()}
    assert found == {("brand", "a"): (2, {"dark": 2, "minimal": 1}), ("store", "s.com"): (2, {"dark": 2, "minimal": 1}), ("all", "*"): (3, {"dark": 2, "minimal": 2})}
    assert made.styled == 3


def test_proposals_fall_back(spark):
    rows = [dict(brand="Known", url="https://s.com/x", styles=["dark"])] * 3
    rows += [dict(brand=f"b{k}", url="https://kids.t.com/x", styles=["preppy"]) for k in range(2)] + [dict(brand=f"c{k}", url="https://t.com/x", styles=["sporty"]) for k in range(6)]
    made = profile.built(labelled(spark, rows))
    pieces = spark.createDataFrame(
        [(0, "KNOWN!", "https://s.com", None, None, None), (1, "new", "https://www.t.com/a", ["romantic"], None, None), (2, "new", "https://shop.t.com/a", None, None, None), (3, "new", "https://kids.t.com/a", None, None, None), (4, None, None, None, None, None)],
        "id long, brand string, url string, words array<string>, colours array<string>, groups array<string>",
    )
    found = {r.id: (r.styles, r.confidences) for r in profile.proposed_styles(pieces, made, "id").collect()}
    # Too few pieces are labelled to judge words, so they count by half.
    assert found == {0: (["dark"], [1.0]), 1: (["romantic", "sporty"], [0.5, 1.0]), 2: (["sporty"], [1.0]), 3: ([], []), 4: ([], [])}


def test_words_and_tone_have_to_prove_right(spark):
    rows = [dict(brand=f"b{k}", name="Tweed coat", styles=["academic"] if k % 10 else ["dark"], colours=["Black"], groups=["Black"]) for k in range(60)]
    rows += [dict(brand="Noir", name="Floral", styles=["dark"], colours=["jet black"], groups=["Black"])] * 6
    made = profile.built(labelled(spark, rows))
    assert made.agreement == {"academic": (60, 54), "romantic": (6, 0)} and made.dark == (66, 12) and made.dark_in_brands == (12, 12)
    piece = lambda brand, words: (brand, None, words, ["black"], ["Black"])
    pieces = spark.createDataFrame([(0, *piece("x", ["academic", "romantic"])), (1, *piece("noir", []))], "id long, brand string, url string, words array<string>, colours array<string>, groups array<string>")
    found = {r.id: r.styles for r in profile.proposed_styles(pieces, made, "id").collect()}
    assert found == {0: ["academic"], 1: ["dark"]}


def test_genders(spark):
    rows = [dict(brand="W", url="https://s.com/x", gender="women")] * 4 + [dict(brand="M", name="for men", gender="women")] * 4 + [dict(brand=f"n{k}", url="https://u.com/x", gender="men") for k in range(5)]
    made = profile.built(labelled(spark, rows))
    pieces = spark.createDataFrame([(0, "w", None, None), (1, "m", None, None), (2, "zz", "https://eu.u.com/x", None), (3, "w", None, "unisex")], "id long, brand string, url string, setting string")
    found = {r.id: (r.gender, r.source) for r in profile.proposed_genders(pieces, made, "id").collect()}
    assert found == {0: ("women", "brand"), 1: (None, None), 2: ("men", "store"), 3: ("unisex", "store-setting")}


def test_nothing_labelled(spark):
    made = profile.built(labelled(spark, [dict()]).limit(0))
    assert made.styled == 0 and made.agreement == {} and made.styles.count() == 0
    pieces = spark.createDataFrame([(0, "w", None, ["dark"], None, None)], "id long, brand string, url string, words array<string>, colours array<string>, groups array<string>")
    assert [r.styles for r in profile.proposed_styles(pieces, made, "id").collect()] == [["dark"]]

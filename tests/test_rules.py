import hashlib

import pytest

from sparkronym.functions.stem import stem
from sparkronym.operators import matchers as m


@pytest.mark.parametrize(
    ("rule", "text", "want"),
    [
        ("schwartz_hearst", "A relational database management system (RDBMS) stores rows.", {"RDBMS": "relational database management system"}),
        ("schwartz_hearst", "RDBMS (relational database management system) stores rows.", {"RDBMS": "relational database management system"}),
        ("schwartz_hearst", "a line that begins small (ALBS) is no paragraph", {"ALBS": None}),
        ("boundaries", "The Portable Document Format (PDF) is old.", {"PDF": "Portable Document Format"}),
        ("boundaries", "NLP: natural language processing is fun.", {"NLP": "natural language processing"}),
        ("boundaries", "We train a SVM - support vector machine.", {"SVM": "support vector machine"}),
        ("boundaries", "The third generation partnership project (3GPP) met.", {"3GPP": "third generation partnership project"}),
        ("character_match", "We use a Support Vector Machine ( SVM ) and LDA ( latent dirichlet allocation ) .", {"SVM": "Support Vector Machine", "LDA": "latent dirichlet allocation"}),
        ("character_match", "It uses a relational database management system ( RDBMS ) and deoxyribonucleic acid ( DNA ) .", {"RDBMS": "relational database management system", "DNA": "deoxyribonucleic acid"}),
        ("character_match", "The XML ( extensible markup language ) file", {"XML": None}),
        ("character_match", "The XML ( xtensible markup language ) file", {"XML": "xtensible markup language"}),
        ("cascade", "NATO stands for North Atlantic Treaty Organization.", {"NATO": "North Atlantic Treaty Organization"}),
        ("cascade", "BERT (Bidirectional Encoder Representations from Transformers)", {"BERT": "Bidirectional Encoder Representations from Transformers"}),
        ("french", "L'Organisation des Nations Unies (ONU) et le PIB (produit intérieur brut).", {"ONU": "Organisation des Nations Unies", "PIB": "produit intérieur brut"}),
    ],
)
def test_rule(rule, text, want):
    got = m.RULES[rule](text)
    assert {k: got.get(k) for k in want} == want


def test_rejections():
    assert m.schwartz_hearst("The letter (A) stands alone.") == {}
    assert m.schwartz_hearst("We like an apple (A) today.") == {}
    assert not m.plausible("ABC", "the ABC")
    assert m.match_right_to_left("XYZ", "nothing like it") is None
    assert m.cascade("Chapter II (second part)") == {}


def test_tags():
    tokens = "support vector machine ( SVM )".split()
    tags = ["B-long", "I-long", "I-long", "O", "B-short", "O"]
    assert m.pairs_from_tags(tokens, tags) == {"SVM": "support vector machine"}
    assert m.chunks(["a", "b", "c"], ["B-x", "B-x", "I-y"]) == [("x", 0, 1), ("x", 1, 2), ("y", 2, 3)]


def test_best_expansion():
    assert m.best_expansion(m.schwartz_hearst, "RDBMS", "A relational database management system") == "relational database management system"


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("happy", "happi"), ("formalize", "formal"), ("adjustment", "adjust"), ("controlling", "control"), ("sky", "sky")])
def test_stem(word, want):
    assert stem(word) == want


def test_long_words_and_chains(spark):
    """No length of a word, tag or chain of similar expansions ends what is judged."""
    from sparkronym.functions import acronyms as A
    from sparkronym.functions import text as X
    from sparkronym.operators import linkage as Ln

    d = spark.createDataFrame([("A" + "b" * 1500 + "C x" + "y" * 1500, ["U-" + "t" * 1500, "L-x"])], "text string, tags array<string>")
    r = d.select(A.candidate_tokens("text").alias("c"), A.is_candidate("text", english=["x"]).alias("ok"), X.convert_tags("tags", "BIOUL").alias("t")).first()
    assert r["c"] == ["A" + "b" * 1500 + "C"] and r["t"] == ["B-" + "t" * 1500, "I-x"]
    name = lambda k: "".join(chr(97 + int(c, 16)) for c in hashlib.md5(str(k).encode()).hexdigest()[:14])  # noqa: E731  unlike each other
    links = spark.createDataFrame([("X", name(k + m), str(k)) for k in range(70) for m in (0, 1)] + [("X", name(900), "z"), ("X", name(901), "z")], "acronym string, expansion string, article_id string")
    got = {x["expansion"]: x["cluster"] for x in Ln.clusters(links).collect()}
    chain, pair = [name(k) for k in range(71)], [name(900), name(901)]
    assert got == dict.fromkeys(chain, min(chain)) | dict.fromkeys(pair, min(pair))


def test_places(spark):
    from sparkronym.operators import splits as Sp

    values = [(k * 7919) % 5003 for k in range(5000)]
    got = Sp.placed(spark.createDataFrame([(v,) for v in values], "v long"), "v").collect()
    assert {r["v"]: r["place"] for r in got} == {v: k + 1 for k, v in enumerate(sorted(values))}

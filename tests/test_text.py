import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.cleantext import SYMBOLS, clean_text
from lodestone.functions.porter2 import stem
from lodestone.functions.stopwords import STOP_WORDS


@pytest.mark.parametrize(
    "dirty,clean",
    [
        ("HIV-1 (human virus) binds.", "hiv_1 bind . human virus . "),
        ("f(x) is 3.5", "fx is 35 . "),
        ("a (b) c (d) e", "a c e . d . b . "),
        ("Don't stop! (unclosed", "dont stop . unclos . "),
        ("β-catenin", "{beta}_catenin . "),
        ("", ""),
        (None, ""),
        ("...", ""),
        ("a) b) c", "a b c . "),
        ("x (y)z", "xyz . "),
    ],
)
def test_clean_text(dirty, clean):
    assert clean_text(dirty) == clean


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_clean_text_never_fails_and_is_ascii_lower(text):
    out = clean_text(text)
    assert out == out.lower() and out.isascii()
    assert ". . " not in out


def test_symbols():
    assert SYMBOLS["α"] == "alpha" and SYMBOLS["λ"] == "lambda" and SYMBOLS["²"] == "^2" and SYMBOLS["₃"] == "_3" and "ς" not in SYMBOLS


@pytest.mark.parametrize("word,root", [("caresses", "caress"), ("flies", "fli"), ("ties", "tie"), ("hopping", "hop"), ("hoping", "hope"), ("generously", "generous"), ("relational", "relat"), ("conditional", "condit"), ("happy", "happi"), ("say", "say"), ("skies", "sky"), ("news", "news"), ("sky", "sky"), ("agreed", "agre"), ("knightly", "knight"), ("consistency", "consist"), ("by", "by")])
def test_stem(word, root):
    assert stem(word) == root


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_phrases_and_stop_words(spark):
    assert one(spark, "the <phrase>heart attack</phrase> risk <b", X.underscore_phrases) == "the heart_attack risk <b"
    assert one(spark, "the heart_attack the risk risk", lambda c: X.remove_stop_words(X.tokens(c))) == ["heart_attack", "risk", "risk"]
    assert len(STOP_WORDS) == 434


def test_labels(spark):
    assert one(spark, "PMID123_2", X.paper_id) == "123" and one(spark, "PMID123_2", X.paper_version) == 2
    with pytest.raises(Exception, match="not a paper"):
        one(spark, "C01", X.paper_id)
    for word, clean in (("C0001", "C0001"), ("PMID7", "PMID7"), ("Aspirin", "aspirin"), ("PMID7_1", "PMID7_1"), ("C1x", "c1x")):
        assert one(spark, word, X.sanitize) == clean
    assert [one(spark, w, X.kind) for w in ("PMID1", "C1", "heart", "Xy")] == ["paper", "concept", "ngram", "other"]


def test_validate(spark):
    words, labels = spark.createDataFrame([("a",), ("a",), ("b",)], ["word"]), spark.createDataFrame([("a",)], ["label"])
    with pytest.raises(ValueError, match="Failed to find: b"):
        X.validate(words, labels)
    X.validate(words.where("word = 'a'"), labels)


def test_titles_and_groups(spark):
    assert one(spark, "<h1 class='x'>A <b>big</b> one</h1><h1>no</h1>", X.page_title) == "no"
    assert one(spark, "<h1 class='x'>A <b>big</b> one</h1>", X.page_title) == " one"
    assert one(spark, "<H1>A <!-- mark -->title</H1>", X.page_title) == "title"
    assert one(spark, "<h1></h1>", X.page_title) is None
    assert one(spark, "<p>none</p>", X.page_title) is None
    assert [one(spark, n, X.topic_node_group) for n in ("Topic_1*", "Topic_1", "heart")] == [2, 1, 3]
    assert one(spark, None, lambda c: X.tokens(c)) == []
    assert one(spark, "l y a b", lambda c: X.tokens(c, 2)) == ["a", "b"]
    assert one(spark, "a . b .", X.remove_lone_periods) == "a b"


def test_phrases_of_any_length(spark):
    docs = spark.createDataFrame([("d", "a b c d e f a b".split())], "doc string, tokens array<string>")
    phrases = spark.createDataFrame([("a b",), ("b c d e f a",), ("z z",), ("a",)], "phrase string")
    assert {(r.phrase, r.n) for r in X.mine_phrases(docs, phrases).collect()} == {("a b", 2), ("b c d e f a", 1)}
    assert X.mine_phrases(docs, phrases.where("phrase = 'a'")).isEmpty()


def test_learned_phrases(spark):
    """Words that stand together are told from those that meet by chance, also where the list hasn't them."""
    import random

    from lodestone.operators import phrases

    rng = random.Random(3)
    good = ["heart attack", "blood cell count", "skin rash", "gene therapy", "bone marrow"]
    rows = [(f"d{k}", " ".join(rng.choice(good) if rng.random() < 0.2 else f"w{int(rng.random() ** 2 * 40)}" for _ in range(60)).split()) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc string, tokens array<string>")
    made = {r.phrase: r.quality for r in phrases.learn(docs, spark.createDataFrame([(x,) for x in good[:3]], "phrase string")).collect()}
    assert all(made[x] > 0.5 for x in good) and sum(q < 0.5 for q in made.values()) > 0.9 * (len(made) - len(good))
    found = phrases.segment(docs, spark.createDataFrame([(x, made[x]) for x in good], "phrase string, quality double"))
    assert found.agg({"n": "sum"}).first()[0] == sum(" ".join(t).count(x) for _, t in rows for x in good)
    with pytest.raises(ValueError):
        phrases.learn(docs, spark.createDataFrame([("no such",)], "phrase string"))


def test_cleaning_bounds_its_batches(spark):
    from lodestone import queries

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    queries.clean_text(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 8 << 20


def test_gram_counts_against_brute_force(spark):
    """Only n-grams whose pairs are all frequent are made, and their counts are those of all n-grams counted one by one."""
    import random
    from collections import Counter

    from lodestone.operators import phrases

    rng = random.Random(5)
    rows = [(f"d{k}", [f"w{int(rng.random() ** 3 * 30)}é" for _ in range(rng.choice([0, 1, 2, 7, 60]))]) for k in range(200)] + [("e", [f"x{k}" for k in range(3000)])]
    docs = spark.createDataFrame(rows, "doc string, tokens array<string>").repartition(3)
    for least in (1, 5):
        want = Counter(" ".join(t[i : i + n]) for _, t in rows for n in range(1, 6) for i in range(len(t) - n + 1))
        found = {r.phrase: r.n for r in phrases.gram_counts(docs, 5, least).collect()}
        assert found.pop(None) == sum(len(t) for _, t in rows)
        assert found == {g: n for g, n in want.items() if n >= least}
    bits, _ = phrases.frequent_pairs(docs, 5)
    often = sum(n >= 5 for g, n in want.items() if g.count(" ") == 1)
    assert len(bits) <= often * phrases.BITS / 8 + 8 * phrases.PARTS  # grows with what is frequent, not with the corpus

import math

import pytest
from pyspark.sql import functions as F

from tickframe.functions import text as X
from tickframe.operators import text as T

TEXTS = [
    (1, "AA", "Good coin, see http://x.y/z?q=1 now!!"),
    (2, "AA", "!!! ... ?"),
    (3, "BB", ""),
    (4, "BB", "the and of not"),
    (5, "BB", "bad bad good; very Good prices' boxes"),
    (6, "CC", None),
    (7, "CC", "“Cannot” wanna it's don't a.b.c x"),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "mention_id int, symbol string, text string")


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([("good", 1.9), ("bad", -2.5), ("great", 3.1)], "token string, valence double")


def tokens_of(df, name="tokens"):
    return {r.mention_id: r[name] for r in df.collect()}


def test_steps(texts):
    one = texts.where("mention_id = 1")
    assert one.select(X.strip_urls("text")).first()[0] == "Good coin, see  now!!"
    assert one.select(X.strip_punct("text")).first()[0] == "Good coin see httpxyzq1 now"
    assert one.select(X.tokenize_lower(F.lit(" A  b\t“C” cannot\n"))).first()[0] == ["a", "b", "“", "c", "”", "can", "not"]
    assert one.select(X.join_tokens(F.array(F.lit("a"), F.lit("b")))).first()[0] == "a b"


def test_punctuation_is_exactly_the_ascii_set(spark):
    import string

    every = "".join(map(chr, range(32, 127))) + "–€é"
    got = spark.range(1).select(X.strip_punct(F.lit(every))).first()[0]
    assert got == "".join(c for c in every if c not in string.punctuation)
    assert sorted(X.PUNCTUATION) == sorted(string.punctuation)


def test_clean_tokens(texts):
    got = tokens_of(T.text_tokens(texts))
    assert got[1] == ["good", "coin", "see"]
    assert got[2] == got[3] == got[4] == got[6] == []
    assert got[5] == ["bad", "bad", "good", "good", "prices", "boxes"]
    assert got[7] == ["“", "”", "wan", "na", "dont", "abc", "x"]


def test_both_ways_of_cleaning_agree(texts):
    steps = X.drop_stopwords(X.tokenize_lower(X.strip_punct(X.strip_urls("text"))))
    want = tokens_of(texts.where("text is not null").withColumn("tokens", steps))
    got = tokens_of(T.text_tokens(texts.where("text is not null")))
    assert got == want


@pytest.mark.parametrize(
    ("word", "lemma"),
    [
        ("boxes", "box"), ("churches", "church"), ("dishes", "dish"), ("stories", "story"), ("wolves", "wolf"),
        ("women", "woman"), ("coins", "coin"), ("glass", "glass"), ("virus", "virus"), ("this", "this"),
        ("gas", "gas"), ("price", "price"),
    ],
)
def test_singular(spark, word, lemma):
    assert spark.range(1).select(X.singular(F.lit(word))).first()[0] == lemma


def test_lemma_table_and_rules(spark, texts):
    words = T.text_tokens(texts)
    table = spark.createDataFrame([("bad", "evil"), ("boxes", "boxen")], "form string, lemma string")
    got = tokens_of(T.lemmatize(words, table))
    assert got[5] == ["evil", "evil", "good", "good", "price", "boxen"]
    assert got[3] == [] and len(got) == len(TEXTS)
    assert tokens_of(T.lemmatize(words))[5] == ["bad", "bad", "good", "good", "price", "box"]
    assert tokens_of(T.preprocess(texts), "clean")[5] == "bad bad good good price box"


def test_a_vocabulary_decides_between_the_forms(spark):
    forms = ["news", "lens", "chaos", "boxes", "axes", "wolves", "gloves", "women", "men", "stories", "movies", "glass", "us", "s", "zzzs", "data"]
    df = spark.createDataFrame([(1, [*forms, None, "boxes"]), (2, []), (3, None)], "mention_id int, tokens array<string>")
    listed = ["news", "lens", "chaos", "box", "ax", "axe", "wolf", "glove", "woman", "men", "man", "story", "movie", "glass", "u", None, "box"]
    vocabulary = spark.createDataFrame([(w, 1) for w in listed], "word string, form int")
    exceptions = spark.createDataFrame([("data", "datum"), ("unused", "x")], "form string, lemma string")
    want = ["news", "lens", "chaos", "box", "ax", "wolf", "glove", "woman", "men", "story", "movie", "glass", "u", "s", "zzzs"]
    assert tokens_of(T.lemmatize(df, vocabulary=vocabulary)) == {1: [*want, "data", "box"], 2: [], 3: []}
    assert tokens_of(T.lemmatize(df, exceptions, vocabulary=vocabulary)) == {1: [*want, "datum", "box"], 2: [], 3: []}
    assert tokens_of(T.lemmatize(df, vocabulary=vocabulary.where("false")))[1] == [*forms, "boxes"]


def test_scores(texts, lexicon):
    scores = {r.mention_id: r for r in T.lexicon_sentiment(T.lemmatize(T.text_tokens(texts)), lexicon).collect()}
    assert len(scores) == len(TEXTS)
    for empty in (2, 3, 4, 6):
        assert tuple(scores[empty])[2:] == (0.0, 0.0, 0.0, 0.0)
    total = 2 * 2.9 + 2 * 3.5 + 2
    s = 2 * 1.9 - 2 * 2.5
    want = (round(5.8 / total, 3), round(7 / total, 3), round(2 / total, 3), round(s / math.sqrt(s * s + 15), 4))
    assert tuple(scores[5])[2:] == pytest.approx(want)
    # one-letter words do not count
    assert scores[7].neutral_sentiment == 1.0


def test_boosters_and_negators(spark, lexicon):
    df = spark.createDataFrame(
        [(1, "a", ["really", "good"]), (2, "a", ["really", "odd", "good"]), (3, "a", ["really", "bad"]),
         (4, "a", ["never", "one", "two", "good"]), (5, "a", ["never", "one", "two", "three", "good"]),
         (6, "a", ["never", "really", "bad"]), (7, "a", [])],
        "mention_id int, symbol string, tokens array<string>",
    )
    out = T.lexicon_sentiment(df, lexicon, boosters={"really": 0.293}, negators=["never"])
    got = {r.mention_id: r.compound_sentiment for r in out.collect()}
    want = {1: 2.193, 2: 1.9 + 0.293 * 0.95, 3: -2.793, 4: -0.74 * 1.9, 5: 1.9, 6: 0.74 * 2.793, 7: 0.0}
    for i, s in want.items():
        assert got[i] == pytest.approx(s / math.sqrt(s * s + 15), abs=1e-4), i


def test_by_symbol_and_label(spark, texts, lexicon):
    scores = T.lexicon_sentiment(T.text_tokens(texts), lexicon)
    by_symbol = T.sentiment_by_symbol(scores)
    got = {r.symbol: r for r in by_symbol.collect()}
    assert got["AA"].mentions == 2 and got["BB"].mentions == 3
    coins = spark.createDataFrame([("1", "AA"), ("2", "zz")], "id string, symbol string")
    labels = {r.id: r.sentiment for r in T.join_coin_sentiment(coins, by_symbol).collect()}
    assert labels == {"1": "positive", "2": "neutral"}
    edge = spark.createDataFrame([(0.05,), (-0.05,), (0.0499,), (None,)], "c double")
    assert [r[0] for r in edge.select(X.sentiment_label("c")).collect()] == ["positive", "negative", "neutral", "neutral"]


def test_small_lexicon_needs_one_shuffle_of_sums(texts, lexicon):
    plan = T.lexicon_sentiment(T.text_tokens(texts), lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning(mention_id") == 1

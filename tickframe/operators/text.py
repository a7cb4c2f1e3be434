"""Lemmas and lexicon sentiment over tables of mentions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.functions.text import clean_tokens, join_tokens, sentiment_label, singular, singular_candidates
from tickframe.session import broadcast_if_small

# Fixed values of the published lexicon-and-rule sentiment model.
NORMALISER = 15.0
NEGATION = -0.74
DAMPING = (1.0, 0.95, 0.9)


def text_tokens(df: DataFrame, *, text: str = "text", stopwords=None, out: str = "tokens") -> DataFrame:
    return df.withColumn(out, clean_tokens(F.coalesce(F.col(text), F.lit("")), stopwords))


def vocabulary_lemmas(words: DataFrame, vocabulary: DataFrame, *, form: str = "form", word: str = "word") -> DataFrame:
    """``(form, lemma)`` of every distinct form that the vocabulary helps to reduce.

    The plural endings propose singulars; those that the vocabulary lists count, and so does
    the form itself if it is listed. The shortest wins, among equally short ones the form, then
    the earlier ending. Forms without a listed candidate have no row. Nulls on either side match nothing.
    """
    forms = words.select(F.col(form).alias("form")).where("form is not null").distinct()
    known = broadcast_if_small(vocabulary.select(F.col(word).alias("_candidate")).distinct())
    proposed = forms.select("form", F.posexplode(singular_candidates(F.col("form"))).alias("_at", "_candidate"))
    held = proposed.join(known, "_candidate", "left_semi")
    best = F.min(F.struct(F.length("_candidate").alias("size"), "_at", F.col("_candidate").alias("lemma")))
    return held.groupBy("form").agg(best.alias("_best")).select("form", F.col("_best.lemma").alias("lemma"))


def lemmatize(
    df: DataFrame,
    lemmas: DataFrame | None = None,
    *,
    vocabulary: DataFrame | None = None,
    tokens: str = "tokens",
    key: str = "mention_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Replace each token by its lemma.

    ``lemmas`` is a table of exceptions ``(form, lemma)`` that come first. For other tokens a
    ``vocabulary`` (a table with the column ``word``) decides between the forms the plural endings
    propose, see ``vocabulary_lemmas``; a token it does not help with stays. Without a vocabulary
    the endings alone decide.

    Without tables this is one expression. With one, tokens become rows, join one table of distinct
    forms, and are put back in order per text; only ``key`` and ``keep`` survive.
    """
    if lemmas is None and vocabulary is None:
        return df.withColumn(tokens, F.transform(tokens, singular))
    ids = [key, *keep]
    rows = df.select(*ids, F.posexplode_outer(tokens).alias("_pos", "form"))
    listed = None if lemmas is None else lemmas.groupBy("form").agg(F.min("lemma").alias("lemma"))
    if vocabulary is not None:
        ruled = vocabulary_lemmas(rows, vocabulary)
        if listed is not None:
            ruled = ruled.join(broadcast_if_small(listed), "form", "left_anti").unionByName(listed)
        known = broadcast_if_small(ruled.where("form != lemma"), keep=True)
    else:
        known = broadcast_if_small(listed)
    matched = rows.join(known, "form", "left")
    word = F.coalesce(F.col("lemma"), F.col("form") if vocabulary is not None else singular(F.col("form")))
    placed = F.collect_list(F.when(F.col("form").isNotNull(), F.struct("_pos", word.alias("w"))))
    back = matched.groupBy(*ids).agg(F.sort_array(placed).alias("_placed"))
    return back.select(*ids, F.transform("_placed", lambda p: p["w"]).alias(tokens))


def preprocess(df: DataFrame, *, text: str = "text", stopwords=None, out: str = "clean") -> DataFrame:
    """The whole cleaning of a text, back to a string."""
    tokens = F.transform(clean_tokens(F.coalesce(F.col(text), F.lit("")), stopwords), singular)
    return df.withColumn(out, join_tokens(tokens))


def _weights(table: Mapping[str, float] | None) -> Column | None:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) if table else None


def _modified(
    df: DataFrame, valences: DataFrame, tokens: str, ids: list[str], strength: Column | None, negators: Sequence[str]
) -> DataFrame:
    """Token rows whose valence ``_v`` is changed by the three words before them."""
    texts = df.select(*ids, F.filter(tokens, lambda w: F.length(w) > 1).alias("_t"))
    back = range(1, len(DAMPING) + 1)
    # The words next to themselves shifted by one, two and three places; the shifts
    # add rows without a token at the end, which count for nothing.
    shifted = [F.concat(F.array_repeat(F.lit(None).cast("string"), d), F.col("_t")) for d in back]
    names = ["token", *[f"_b{d}" for d in back]]
    rows = texts.select(*ids, F.inline_outer(F.arrays_zip("_t", *shifted)).alias(*names))
    scored = rows.join(valences, "token", "left").withColumn("_v", F.coalesce("valence", F.lit(0.0)))
    for d in back:
        v, word = F.col("_v"), F.col(f"_b{d}")
        if strength is not None:
            v = v + F.signum(v) * F.coalesce(F.try_element_at(strength, word), F.lit(0.0)) * DAMPING[d - 1]
        if negators:
            v = F.when(word.isin(*negators), v * NEGATION).otherwise(v)
        scored = scored.withColumn("_v", F.when(F.col("_v") != 0, v).otherwise(F.lit(0.0)))
    return scored


def lexicon_sentiment(
    df: DataFrame,
    lexicon: DataFrame,
    *,
    tokens: str = "tokens",
    key: str = "mention_id",
    keep: Sequence[str] = ("symbol",),
    boosters: Mapping[str, float] | None = None,
    negators: Sequence[str] = (),
) -> DataFrame:
    """Positive, negative and neutral shares and the compound score of each text.

    ``lexicon`` is a table ``(token, valence)``. Tokens become rows that join it and
    are summed per text, so nothing is gathered; with a lexicon small enough to
    broadcast only one partial sum per text is shuffled. One-letter tokens
    do not count. ``boosters`` (word to strength) and ``negators`` act on the three
    words before a scored one.
    """
    valences = broadcast_if_small(lexicon.groupBy("token").agg(F.max("valence").alias("valence")))
    if boosters or negators:
        scored = _modified(df, valences, tokens, [key, *keep], _weights(boosters), negators)
    else:
        rows = df.select(key, *keep, F.explode_outer(tokens).alias("token"))
        rows = rows.withColumn("token", F.when(F.length("token") > 1, F.col("token")))
        scored = rows.join(valences, "token", "left").withColumn("_v", F.coalesce("valence", F.lit(0.0)))
    sums = scored.groupBy(key, *keep).agg(
        F.sum("_v").alias("_s"),
        F.sum(F.when(F.col("_v") > 0, F.col("_v") + 1).otherwise(0.0)).alias("_p"),
        F.sum(F.when(F.col("_v") < 0, 1 - F.col("_v")).otherwise(0.0)).alias("_n"),
        F.count(F.when((F.col("_v") == 0) & F.col("token").isNotNull(), 1)).alias("_z"),
    )
    total = F.col("_p") + F.col("_n") + F.col("_z")

    def share(part: str) -> Column:
        return F.round(F.coalesce(F.try_divide(F.col(part), total), F.lit(0.0)), 3)

    compound = F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + NORMALISER)
    return sums.select(
        key,
        *keep,
        share("_p").alias("positive_sentiment"),
        share("_n").alias("negative_sentiment"),
        share("_z").alias("neutral_sentiment"),
        F.round(compound, 4).alias("compound_sentiment"),
    )


def sentiment_by_symbol(scores: DataFrame, *, key: str = "symbol") -> DataFrame:
    """Mean scores and number of mentions per symbol."""
    parts = ("positive_sentiment", "negative_sentiment", "neutral_sentiment", "compound_sentiment")
    return scores.groupBy(key).agg(*[F.avg(c).alias(c) for c in parts], F.count(F.lit(1)).alias("mentions"))


def join_coin_sentiment(coins: DataFrame, by_symbol: DataFrame, *, key: str = "symbol") -> DataFrame:
    """Each coin with its sentiment label; neutral where nobody mentions it."""
    scored = by_symbol.select(key, "compound_sentiment", sentiment_label("compound_sentiment").alias("sentiment"))
    return coins.join(broadcast_if_small(scored, keep=True), key, "left").withColumn("sentiment", F.coalesce("sentiment", F.lit("neutral")))


def join_sentiment_market(by_symbol: DataFrame, market: DataFrame, *, key: str = "symbol") -> DataFrame:
    return by_symbol.join(market, key)

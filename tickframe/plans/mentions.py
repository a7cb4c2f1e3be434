"""Registered queries on texts: cleaning steps, lexicon sentiment, and its joins to the market."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.functions import text as X
from tickframe.operators import text as T
from tickframe.operators.stats import long_term_benefit, market_analysis
from tickframe.plans.adapters import BRAND_PRICES, MARKET, MENTIONS, brand_prices, market, mentions, rounded, sql_rounded
from tickframe.plans.registry import query
from tickframe.plans.series import _ANALYSIS

# The test texts are invented words, so the lexicon, boosters, negators and lemmas
# handed to the operators here are invented too; a user passes their own tables.
_LEXICON = [
    ("thing", 1.9),
    ("best", 3.2),
    ("good", 1.9),
    ("bad", -2.5),
    ("worst", -3.1),
    ("er", -0.6),
    ("hehely", 2.2),
    ("orre", -1.7),
    ("inoran", -2.4),
    ("ononst", 0.9),
    ("thea", -1.1),
    ("ther", 0.8),
    ("leaux", 1.3),
    ("onon", -0.4),
]
_BOOSTERS = {"rewh": 0.293, "es": -0.293, "orantion": 0.293}
_NEGATORS = ["nd", "thth"]
_LEMMAS = [("rewh", "rewe"), ("thatin", "thata"), ("es", "e"), ("letretre", "letre")]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_STOP = "[" + ", ".join(_quoted(w) for w in X.STOPWORDS) + "]"
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"


def _no_urls(text: str) -> str:
    return rf"regexp_replace({text}, 'http\S+', '', 'g')"


def _no_punct(text: str) -> str:
    return f"translate({text}, {_quoted(X.PUNCTUATION)}, '')"


def _tokens(text: str) -> str:
    quotes = rf"regexp_replace(lower({text}), '([«»“”„‘’])', ' \1 ', 'g')"
    words = f"list_filter(string_split_regex({quotes}, '{_SPACE}'), lambda w: w <> '')"
    cases = " ".join(
        f"when '{w}' then [{', '.join(_quoted(p) for p in parts.split())}]" for w, parts in X.JOINED_WORDS.items()
    )
    return f"flatten(list_transform({words}, lambda w: case w {cases} else [w] end))"


def _kept(tokens: str) -> str:
    return f"list_filter({tokens}, lambda w: not list_contains({_STOP}, w))"


def _singular(word: str) -> str:
    keep = " or ".join(f"ends_with({word}, '{e}')" for e in X.NOT_PLURAL)
    cases = " ".join(
        f"when ends_with({word}, '{end}') then {word}[:-{len(end) + 1}] || '{to}'" for end, to in X.PLURAL_ENDINGS
    )
    return f"case when {keep} or length({word}) < 4 then {word} {cases} else {word} end"


_CLEAN = _kept(_tokens(_no_punct(_no_urls("text"))))
_BASE = f"{MENTIONS}, t as (select mention_id, symbol, {_CLEAN} as tokens from mentions)"


def _clean(spark, sf):
    return T.text_tokens(mentions(spark, sf))


def _joined(tokens) -> list:
    return [F.size(tokens).cast("long").alias("n"), F.array_join(tokens, " ").alias("joined")]


# --- cleaning steps ---------------------------------------------------------


@query(
    "strip_urls",
    f"""with {MENTIONS} select mention_id, {_no_urls("'see https://x.org/a?b=1 ' || text || ' http://y.z'")} as text
    from mentions""",
)
def strip_urls(spark, sf):
    linked = F.concat(F.lit("see https://x.org/a?b=1 "), "text", F.lit(" http://y.z"))
    return mentions(spark, sf).select("mention_id", X.strip_urls(linked).alias("text"))


@query("strip_punct", f"with {MENTIONS} select mention_id, {_no_punct('text')} as text from mentions")
def strip_punct(spark, sf):
    return mentions(spark, sf).select("mention_id", X.strip_punct("text").alias("text"))


@query(
    "tokenize_lower",
    f"""with {MENTIONS}, t as (select mention_id, {_tokens("text || ' “Cannot” Gonna'")} as w from mentions)
    select mention_id, cast(len(w) as bigint) as n, array_to_string(w, ' ') as joined from t""",
)
def tokenize_lower(spark, sf):
    words = X.tokenize_lower(F.concat("text", F.lit(" “Cannot” Gonna")))
    return mentions(spark, sf).select("mention_id", words.alias("w")).select("mention_id", *_joined(F.col("w")))


@query(
    "drop_stopwords",
    f"""with {_BASE} select mention_id, cast(len(tokens) as bigint) as n, array_to_string(tokens, ' ') as joined
    from t""",
)
def drop_stopwords(spark, sf):
    return _clean(spark, sf).select("mention_id", *_joined(F.col("tokens")))


@query(
    "lemmatize",
    f"""with {_BASE}, w as (select mention_id, list_transform(tokens, lambda w: case w {' '.join(
        f"when '{f}' then '{to}'" for f, to in _LEMMAS)} else {_singular('w')} end) as tokens from t)
    select mention_id, cast(len(tokens) as bigint) as n, array_to_string(tokens, ' ') as joined from w""",
)
def lemmatize(spark, sf):
    table = spark.createDataFrame(_LEMMAS, "form string, lemma string")
    return T.lemmatize(_clean(spark, sf), table).select("mention_id", *_joined(F.col("tokens")))


def _proposed(word: str) -> str:
    made = [
        f"case when ends_with({word}, '{end}') and length({word}) > {len(end)} then {word}[:-{len(end) + 1}] || '{to}' end"
        for end, to in X.PLURAL_ENDINGS
    ]
    return f"[{word}, {', '.join(made)}]"


#: Words seen this often make up the vocabulary of the query.
_FREQUENT = 3


@query(
    "lemmatize_vocabulary",
    f"""with {_BASE}, lemmas(form, lemma) as (values {', '.join(f"('{f}', '{to}')" for f, to in _LEMMAS)}),
    p as (select mention_id, unnest(tokens) as form, generate_subscripts(tokens, 1) as pos from t),
    vocabulary as (select form as word from p group by form having count(*) >= {_FREQUENT}),
    forms as (select distinct form from p),
    proposed as (select form, unnest({_proposed('form')}) as word, generate_subscripts({_proposed('form')}, 1) as nth from forms),
    best as (select form, first(word order by length(word), nth) as lemma from proposed semi join vocabulary using (word) group by form),
    w as (select mention_id, list(coalesce(l.lemma, b.lemma, form) order by pos) as tokens
        from p left join lemmas l using (form) left join best b using (form) group by mention_id)
    select mention_id, cast(coalesce(len(w.tokens), 0) as bigint) as n, coalesce(array_to_string(w.tokens, ' '), '') as joined
    from t left join w using (mention_id)""",
)
def lemmatize_vocabulary(spark, sf):
    """Endings propose, the words that the texts often hold decide, exceptions come first."""
    words = _clean(spark, sf)
    frequent = words.select(F.explode("tokens").alias("word")).groupBy("word").count().where(F.col("count") >= _FREQUENT)
    table = spark.createDataFrame(_LEMMAS, "form string, lemma string")
    return T.lemmatize(words, table, vocabulary=frequent).select("mention_id", *_joined(F.col("tokens")))


@query(
    "join_tokens",
    f"""with {_BASE} select mention_id, array_to_string(list_transform(tokens, lambda w: {_singular('w')}), ' ')
    as clean from t""",
)
def join_tokens(spark, sf):
    """The whole cleaning, as text."""
    return T.preprocess(mentions(spark, sf)).select("mention_id", "clean")


# --- sentiment --------------------------------------------------------------


def _scores_sql(boosted: bool) -> str:
    lexicon = ", ".join(f"('{w}', {v}::double)" for w, v in _LEXICON)
    steps = ["v0 as (select r.*, coalesce(valence, 0) as v from r left join lexicon l on r.token = l.token)"]
    if boosted:
        cases = " ".join(f"when '{w}' then {v}::double" for w, v in _BOOSTERS.items())
        negators = ", ".join(_quoted(w) for w in _NEGATORS)
        for d, damp in enumerate(T.DAMPING, 1):
            steps.append(
                f"v{d} as (select * exclude (v), case when b{d} in ({negators}) then {T.NEGATION}::double else 1 end * "
                f"(v + sign(v) * case b{d} {cases} else 0 end * {damp}::double) as v from v{d - 1})"
            )
    last = f"v{len(T.DAMPING) if boosted else 0}"
    lags = ", ".join(f"lag(token, {d}) over (partition by mention_id order by pos) as b{d}" for d in (1, 2, 3))
    return f"""lexicon(token, valence) as (values {lexicon}),
    u as (select mention_id, symbol, list_filter(list_transform(tokens, lambda w: {_singular('w')}),
        lambda w: length(w) > 1) as tokens from t),
    p as (select mention_id, unnest(tokens) as token, generate_subscripts(tokens, 1) as pos from u),
    r as (select *, {lags} from p),
    {', '.join(steps)},
    a as (select mention_id, sum(v) as s, sum(case when v > 0 then v + 1 else 0 end) as pos,
        sum(case when v < 0 then 1 - v else 0 end) as neg, count(*) filter (v = 0) as neu from {last} group by 1),
    scores as (select u.mention_id, u.symbol,
        round(coalesce(pos / nullif(pos + neg + neu, 0), 0), 3) as positive_sentiment,
        round(coalesce(neg / nullif(pos + neg + neu, 0), 0), 3) as negative_sentiment,
        round(coalesce(neu / nullif(pos + neg + neu, 0), 0), 3) as neutral_sentiment,
        round(coalesce(s / sqrt(s * s + {T.NORMALISER}::double), 0), 4) as compound_sentiment
        from u left join a on u.mention_id = a.mention_id)"""


def _scores(spark, sf, boosted: bool = False):
    lexicon = spark.createDataFrame(_LEXICON, "token string, valence double")
    words = T.lemmatize(_clean(spark, sf))
    extra = {"boosters": _BOOSTERS, "negators": _NEGATORS} if boosted else {}
    return T.lexicon_sentiment(words, lexicon, **extra)


_PARTS = ("positive_sentiment", "negative_sentiment", "neutral_sentiment", "compound_sentiment")


@query("lexicon_sentiment", f"with {_BASE}, {_scores_sql(True)} select mention_id, symbol, {', '.join(_PARTS)} from scores")
def lexicon_sentiment(spark, sf):
    """With boosters and negators in the three words before a scored one."""
    return _scores(spark, sf, boosted=True).select("mention_id", "symbol", *_PARTS)


_BY_SYMBOL = f"""by_symbol as (select symbol, {', '.join(f'avg({c}) as {c}' for c in _PARTS)}, count(*) as mentions
    from scores group by 1)"""


def _by_symbol(spark, sf):
    return T.sentiment_by_symbol(_scores(spark, sf))


@query(
    "sentiment_by_symbol",
    f"with {_BASE}, {_scores_sql(False)}, {_BY_SYMBOL} select symbol, {sql_rounded(8, *_PARTS)}, mentions from by_symbol",
)
def sentiment_by_symbol(spark, sf):
    return _by_symbol(spark, sf).select("symbol", *rounded(8, *_PARTS), "mentions")


_LABEL = f"""case when compound_sentiment >= {X.POSITIVE_FROM} then 'positive'
    when compound_sentiment <= {X.NEGATIVE_FROM} then 'negative' else 'neutral' end"""


@query("sentiment_label", f"with {_BASE}, {_scores_sql(False)} select mention_id, {_LABEL} as label from scores")
def sentiment_label(spark, sf):
    return _scores(spark, sf).select("mention_id", X.sentiment_label("compound_sentiment").alias("label"))


_DATA_SYMBOL = "case when cast(id as bigint) % 10 = 0 then 'unlisted' else symbol end"


@query(
    "join_coin_sentiment",
    f"""with {_BASE}, {_scores_sql(False)}, {_BY_SYMBOL}, {MARKET},
    coins as (select id, {_DATA_SYMBOL} as symbol from market)
    select id, coins.symbol, round(compound_sentiment, 8) as compound_sentiment, {_LABEL} as sentiment
    from coins left join by_symbol on coins.symbol = by_symbol.symbol""",
)
def join_coin_sentiment(spark, sf):
    """Some coins have a symbol nobody mentions."""
    coins = market(spark, sf).select("id", F.expr(_DATA_SYMBOL).alias("symbol"))
    joined = T.join_coin_sentiment(coins, _by_symbol(spark, sf))
    return joined.select("id", "symbol", *rounded(8, "compound_sentiment"), "sentiment")


_MARKET_PARTS = ("mean_return", "volatility", "momentum", "max_drawdown")


@query(
    "join_sentiment_market",
    f"""with {_BASE}, {_scores_sql(False)}, {_BY_SYMBOL}, {BRAND_PRICES}, {_ANALYSIS}
    select symbol, {sql_rounded(8, 'compound_sentiment', *_MARKET_PARTS)}, mentions from by_symbol
    join analysis using (symbol)""",
)
def join_sentiment_market(spark, sf):
    joined = T.join_sentiment_market(_by_symbol(spark, sf), market_analysis(brand_prices(spark, sf)))
    return joined.select("symbol", *rounded(8, "compound_sentiment", *_MARKET_PARTS), "mentions")


def _z(column: str) -> str:
    return f"coalesce(({column} - avg({column}) over ()) / nullif(stddev_samp({column}) over (), 0), 0)"


@query(
    "long_term_benefit",
    f"""with {_BASE}, {_scores_sql(False)}, {_BY_SYMBOL}, {BRAND_PRICES}, {_ANALYSIS}
    select symbol, {sql_rounded(8, 'momentum', 'volatility', 'compound_sentiment')},
    round({_z('momentum')} - {_z('volatility')} + {_z('compound_sentiment')}, 8) as score
    from by_symbol join analysis using (symbol)""",
)
def long_term_benefit_query(spark, sf):
    ranked = long_term_benefit(market_analysis(brand_prices(spark, sf)), _by_symbol(spark, sf))
    ranked = ranked.orderBy(F.col("score").desc_nulls_last(), "symbol")
    return ranked.select("symbol", *rounded(8, "momentum", "volatility", "compound_sentiment", "score"))

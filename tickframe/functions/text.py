"""Column expressions that clean and tokenise text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32 ASCII punctuation characters, deleted without a space, and
# the same as ranges of a character class.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_PUNCT = "[!-/:-@\\[-`{-~]"

# Typographic quotes that the usual tokeniser sets apart.
QUOTES = "«»“”„‘’"

# The usual English stop-word list of natural-language tool kits.
# Entries with an apostrophe never match once punctuation is gone.
STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves "
    "he him his himself she she's her hers herself it it's its itself they them their theirs themselves "
    "what which who whom this that that'll these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't "
    "couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn "
    "mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't "
    "wouldn wouldn't"
).split()

# Joined words that the usual tokeniser takes apart.
JOINED_WORDS = {
    "cannot": "can not",
    "gimme": "gim me",
    "gonna": "gon na",
    "gotta": "got ta",
    "lemme": "lem me",
    "wanna": "wan na",
}

#: The first part of a joined word that stands between blanks.
_JOINED = "(?U)(?<!\\S)({})".format(
    "|".join("{}(?={}(?!\\S))".format(*parts.split()) for parts in JOINED_WORDS.values())
)

# Endings of regular English plurals and what stands in the singular.
PLURAL_ENDINGS = [
    ("ches", "ch"),
    ("shes", "sh"),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ies", "y"),
    ("men", "man"),
    ("s", ""),
]
#: Singular words often end like this, so the bare ``s`` stays.
NOT_PLURAL = ("ss", "us", "is")

# Sentiment label thresholds on the compound score.
POSITIVE_FROM = 0.05
NEGATIVE_FROM = -0.05


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_urls(c: Column | str) -> Column:
    text = _col(c)
    return F.when(text.contains("http"), F.regexp_replace(text, r"(?U)http\S+", "")).otherwise(text)


def strip_punct(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), _PUNCT, "")


def _any_of(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def _split_words(lowered: Column) -> Column:
    """Words between blanks, with typographic quotes set apart and joined words taken apart.

    Both are rare, so plain searches decide whether a pattern has to run. The text
    is bound to a lambda variable, which keeps it from being computed per use.
    """

    def words(text: Column) -> Column:
        apart = F.when(_any_of(text, QUOTES), F.regexp_replace(text, f"([{QUOTES}])", " $1 ")).otherwise(text)
        plain = F.when(_any_of(text, JOINED_WORDS), F.regexp_replace(apart, _JOINED, "$1 ")).otherwise(apart)
        return F.split(plain, r"(?U)\s+")

    return F.get(F.transform(F.array(lowered), words), F.lit(0))


def tokenize_lower(c: Column | str) -> Column:
    """Lower-case words; typographic quotes stand alone and joined words are taken apart."""
    return F.filter(_split_words(F.lower(_col(c))), lambda w: w != "")


def is_stopword(word: Column, stopwords=None) -> Column:
    return word.isin(list(STOPWORDS if stopwords is None else stopwords))


def drop_stopwords(tokens: Column | str, stopwords=None) -> Column:
    return F.filter(_col(tokens), lambda w: ~is_stopword(w, stopwords))


def singular(word: Column) -> Column:
    """A regular plural's singular; other words come back as they are."""
    kept = reduce(lambda a, b: a | b, [word.endswith(e) for e in NOT_PLURAL])
    plural = word.endswith("s") | word.endswith("men")
    out = F.when(~plural | kept | (F.length(word) < 4), word)
    for end, to in PLURAL_ENDINGS:
        stem = word.substr(F.lit(1), F.length(word) - len(end))
        out = out.when(word.endswith(end), F.concat(stem, F.lit(to)) if to else stem)
    return out.otherwise(word)


def singular_candidates(word: Column) -> Column:
    """The word and what every fitting plural ending makes of it, in the order of the endings."""
    made = [word]
    for end, to in PLURAL_ENDINGS:
        stem = word.substr(F.lit(1), F.length(word) - len(end))
        made.append(F.when(word.endswith(end) & (F.length(word) > len(end)), F.concat(stem, F.lit(to))))
    return F.array_compact(F.array(*made))


def join_tokens(tokens: Column | str) -> Column:
    return F.array_join(_col(tokens), " ")


def clean_tokens(c: Column | str, stopwords=None) -> Column:
    """Text to words: URLs, punctuation and stop words removed, lower case."""
    words = _split_words(F.lower(strip_punct(strip_urls(c))))
    return F.filter(words, lambda w: (w != "") & ~is_stopword(w, stopwords))


def sentiment_label(compound: Column | str) -> Column:
    c = _col(compound)
    return (
        F.when(c >= POSITIVE_FROM, "positive").when(c <= NEGATIVE_FROM, "negative").otherwise("neutral")
    )

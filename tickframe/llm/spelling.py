"""Spelling variants: words one edit apart, found by PartEnum signatures.

A word is the multiset of its letters, a binary vector with one dimension per letter and
occurrence ("second e"). Replacing a letter changes two dimensions, inserting or deleting one
changes one. The dimensions are dealt into parts by hash; vectors within distance d of each
other agree on all parts but d, so every choice of parts to leave out gives a signature, and
near words share at least one (Arasu, Ganti and Kaushik 2006). As one edit leaves one half of
a word as it is, that half joins the signature: once the first, once the last. Words with an
equal signature meet in an equi-join that verifies the edit, so no near pair is lost.

Everything is DataFrame functions over the distinct words and their counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.neardup import written

#: Parts of the vector for words of equal length (distance two), and of lengths one apart (distance one).
SWAP_PARTS, GAP_PARTS = 4, 2
#: A word's form occurs at least this many times as often.
FACTOR = 10


def _dimensions(word: Column) -> Column:
    """A hash per dimension that the word's multiset sets."""
    letters = F.array_distinct(F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0)))

    def of(letter: Column) -> Column:
        times = F.length(word) - F.length(F.replace(word, letter))
        return F.transform(F.sequence(F.lit(1), times), lambda k: F.xxhash64(letter, k))

    return F.flatten(F.transform(letters, of))


def _parts(dims: Column, parts: int) -> Column:
    """The sum (by exclusive or) of the dimensions that fall into each part."""
    zero = F.lit(0).cast("long")
    part = lambda p: F.filter(dims, lambda d: F.pmod(d, F.lit(parts)) == p)
    return F.array(*(F.aggregate(part(p), zero, lambda s, d: s.bitwiseXOR(d)) for p in range(parts)))


def _signatures(sums: Column, parts: int, distance: int) -> Iterator[Column]:
    """One signature per choice of ``distance`` parts to leave out."""
    for left_out in combinations(range(parts), distance):
        kept = [F.get(sums, F.lit(p)) for p in range(parts) if p not in left_out]
        yield F.xxhash64(F.lit(parts), *(F.lit(p) for p in left_out), *kept)


def _entries(words: DataFrame) -> DataFrame:
    """``word, n, bits, role, key``: role 0 meets 0 among words of one length, 1 (longer) meets 2 (shorter).

    ``bits`` is the vector folded to 64 places, each the parity of its dimensions.
    """
    size = F.length("word")
    head = lambda n: F.substr("word", F.lit(1), n)
    tail = lambda n: F.substr("word", size - n + 1, n)
    entries = []

    def add(role: int, length: Column, signatures: list[Column]) -> None:
        # the halves of the shorter word; a longer one holds one of them at its own end
        first = F.floor(length / 2).cast("int")
        for side, half in enumerate((head(first), tail(length - first))):
            entries.extend(
                F.struct(F.lit(role).alias("role"), F.xxhash64(F.lit(min(role, 1)), F.lit(side), length, half, s).alias("key"))
                for s in signatures
            )

    dims = words.withColumn("dims", _dimensions(F.col("word")))
    place = lambda d: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(d, 58).cast("int"))
    bits = F.aggregate("dims", F.lit(0).cast("long"), lambda s, d: s.bitwiseXOR(place(d)))
    sums = dims.select(
        "word",
        "n",
        bits.alias("bits"),
        _parts(F.col("dims"), SWAP_PARTS).alias("swap"),
        _parts(F.col("dims"), GAP_PARTS).alias("gap"),
    )
    swaps = list(_signatures(F.col("swap"), SWAP_PARTS, 2))
    gaps = list(_signatures(F.col("gap"), GAP_PARTS, 1))
    add(0, size, swaps)
    add(1, size - 1, gaps)
    add(2, size, gaps)
    return sums.select("word", "n", "bits", F.inline(F.array(*entries)))


def near_words(words: DataFrame) -> DataFrame:
    """Pairs ``a, b, a_n, b_n`` of distinct words that one insertion, deletion or replacement tells apart.

    ``words`` has distinct words in ``word`` and counts in ``n``. Each pair comes once.
    """
    entries = _entries(words)
    own = ("role", "word", "n", "bits")
    left = entries.select("key", *(F.col(c).alias(f"a_{c}") for c in own))
    right = entries.select("key", *(F.col(c).alias(f"b_{c}") for c in own))
    # asked in sums, which no side can be filtered by: both sides are then one shuffle, used twice
    roles = F.col("a_role") + F.col("b_role")
    same = (roles == 0) & (F.col("a_word") < F.col("b_word"))
    longer = (roles == 3) & (F.col("a_role") < F.col("b_role"))
    # the distance of the vectors first, which is cheap; what is left has to be one edit
    apart = F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) <= 2
    edit = F.levenshtein("a_word", "b_word", 1) == 1
    # merged, as the words are few bytes on disk but many rows here: their size on disk must not ask for a broadcast
    met = left.alias("l").join(right.alias("r").hint("merge"), (F.col("l.key") == F.col("r.key")) & (same | longer) & apart & edit)
    return met.select(F.col("a_word").alias("a"), F.col("b_word").alias("b"), "a_n", "b_n").distinct()


def _roots(links: DataFrame) -> DataFrame:
    """Where each word ends up that follows ``form``, by pointer doubling.

    Counts grow tenfold with every step, so a chain has at most 19 links and five rounds end it.
    """
    found = written(links.select("word", F.col("form").alias("root")), "links")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = found.join(onward, "root", "left")
        found = written(
            joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots"
        )
        if found.where("moved").isEmpty():
            return found.select("word", "root")
        found = found.select("word", "root")


def group_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``words`` (``word, n``).

    A word's form is its most frequent near word (ties: the first in code-point order) if it
    is ``factor`` times as frequent or more. ``root`` is where forms lead in the end, the word
    itself if it has none. Null words are left out; words must be distinct (counts of repeated
    ones are summed up). No words give no rows.
    """
    words = written(
        words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words"
    )
    pairs = written(near_words(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(
        pairs.select("b", "a", "a_n")
    )
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    large = -F.col("best.minus") >= F.col("n") * factor
    joined = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(large, F.col("best.near")).alias("form"),
        F.when(large, -F.col("best.minus")).alias("form_n"),
    )
    joined = written(joined, "forms")
    roots = _roots(joined.where(F.col("form").isNotNull()))
    return joined.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def letter_runs(text: Column, least: int) -> Column:
    """Maximal runs of Latin letters of at least ``least`` code points, with A-Z in lower case."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(f"[a-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))


def slipped(run: Column, id_col: Column, every: int) -> Column:
    """The run, without one letter where ``every`` divides the checksum of id and run."""
    h = F.crc32(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(h % every == 0, cut).otherwise(run)


def text_words(
    docs: DataFrame, least: int = 7, times: int = 2, every: int = 31, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``word, n``: the words of all texts, some of them with a slip made by checksum.

    Words have ``least`` code points or more after the slip and occur ``times`` or more. Null
    texts hold none, a null id counts as empty, repeated rows count again.
    """
    runs = docs.select(F.col(id_col).alias("id"), F.explode(letter_runs(F.col(text_col), least)).alias("run"))
    words = runs.select(slipped(F.col("run"), F.col("id"), every).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)

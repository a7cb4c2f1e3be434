"""Spelling variants: near pairs against brute force, the query against SQL."""

import random
from collections import Counter

import duckdb
import pytest

from tickframe.llm import spelling
from tickframe.llm.queries import QUERIES, spelling_sql

from . import brute
from .brute import DATA


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(words, factor=10):
    out = {}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= factor * n else None
        out[w] = [form, None, n, len(near[w]), words[form] if form is not None else None]
    for w, row in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        row[1] = root
    return {(w, *row) for w, row in out.items()}


def grouped(frame, **options):
    found = spelling.group_variants(frame, **options).collect()
    return Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found)


@pytest.mark.parametrize("alphabet, longest", [("ab", 7), ("abcdeé", 6), ("a漢😀ñ", 5)])
def test_equals_brute_force(spark, alphabet, longest):
    rng = random.Random(len(alphabet))
    words = {"".join(rng.choices(alphabet, k=rng.randrange(longest + 1))): rng.choice([1, 2, 3, 30, 400]) for _ in range(300)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert grouped(frame) == Counter(plain_groups(words))


def test_chains_ties_and_repeats(spark):
    words = {f"{'x' * k}": 10**k for k in range(1, 12)}  # each form is the next longer word
    words |= {"catch": 1, "batch": 20, "match": 20}
    frame = spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n long")
    assert grouped(frame) == Counter(plain_groups(words))
    roots = {r.word: r.root for r in spelling.group_variants(frame).collect()}
    assert roots["x"] == "x" * 11 and roots["catch"] == "batch"
    twice = frame.union(frame).union(spark.createDataFrame([(None, 5)], "word string, n long"))
    assert grouped(twice) == Counter(plain_groups({w: 2 * n for w, n in words.items()}))


def test_long_words(spark):
    long = "abcdefghij" * 3000
    words = {long: 50, long[:1234] + long[1235:]: 2, long[:-1] + "z": 3, long[:777] + "é" + long[777:]: 1, "z" + long[:-1]: 1}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert grouped(frame) == Counter(plain_groups(words))


def test_query_equals_sql(spark):
    frame = QUERIES["op11_spelling_variants"](spark, DATA)
    answer = duckdb.sql(spelling_sql(f"'{DATA}/documents.parquet'"))
    assert sorted(answer.columns) == sorted(frame.columns)
    assert Counter(map(tuple, frame.select(*answer.columns).collect())) == Counter(answer.fetchall())


def test_odd_rows(spark, odd, none):
    import re

    words = Counter()
    for i, t, *_ in brute.odd_rows():
        lower = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for run in re.findall("[a-zÀ-ÿ]{3,}", lower):
            h = brute.zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 2 == 0 else run
            words[run] += len(run) >= 3
    words = {w: n for w, n in words.items() if n}
    frame = spelling.text_words(odd, least=3, times=1, every=2)
    assert {r.word: r.n for r in frame.collect()} == words
    assert grouped(frame) == Counter(plain_groups(words))
    assert spelling.group_variants(spelling.text_words(none)).count() == 0

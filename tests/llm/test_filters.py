"""Repetition rules, near-duplicates and decontamination."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tickframe.llm import neardup, repetition, tiling
from tickframe.llm import words as W

from . import brute


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a ", "b ", "é", "\n", " ", "c\n", "#", "a b c d e f g h i j k\n", "\x1c", "\x85 ", "<|"]
    return [None, "", " ", "\n", "a\n\na\n"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_words_equal_the_pattern():
    texts = random_texts(100, 1)
    for lo, hi, raw, at in W.chunks(pa.array(texts), 64):
        found = W.split(raw, at)
        body = raw.tobytes()
        for k in range(hi - lo):
            own = range(found.first[k], found.first[k + 1])
            assert [body[found.start[j] : found.end[j]].decode() for j in own] == brute.words(texts[lo + k])


def test_equal_words_hash_alike_wherever_they_are():
    _, _, raw, at = next(W.chunks(pa.array(["ab cd ab", "cd", "AB"])))
    h = W.split(raw, at).hash
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3
    assert len(set(W.split(raw, at, lower=True).hash.tolist())) == 2


def test_measures_equal_brute_force():
    texts = random_texts(300, 2)
    found = repetition.measure(pa.array(texts))
    for k, text in enumerate(texts):
        assert {name: v[k] for name, v in found.items()} == brute.repetition(text)
    part = repetition.measure(pa.array(texts).slice(7, 40))
    assert all((part[name] == v[7:47]).all() for name, v in found.items())


def test_repetition_of_odd_rows(odd, none):
    rows = repetition.repetition(odd).collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.kept) for r in rows))) == sorted(
        map(str, ((i, len(brute.words(t)), brute.repetition(t)["kept"]) for i, t, *_ in brute.odd_rows()))
    )
    assert repetition.repetition(none).collect() == []
    left = repetition.drop_repetitive(odd)
    assert left.schema == odd.schema
    assert Counter(r.text for r in left.collect()) == Counter(
        t for _, t, *_ in brute.odd_rows() if brute.repetition(t)["kept"]
    )
    assert repetition.drop_repetitive(none).count() == 0


@pytest.mark.parametrize("weights", ["ones", "whole", "real"])
def test_signatures_agree_as_the_weighted_similarity(weights):
    rng = np.random.default_rng(3)
    w = {"ones": np.ones(80), "whole": rng.integers(1, 9, 80) * 1.0, "real": rng.random(80) * 5 + 0.01}[weights]
    names = rng.integers(0, 1 << 62, 110).astype(np.uint64)
    other = rng.permutation(w)
    a, b = np.zeros(110), np.zeros(110)
    a[:80], b[30:] = w, other
    row = np.repeat([0, 1], 80)
    found = neardup.dart_signatures(row, np.concatenate((names[:80], names[30:])), np.concatenate((w, other)), 2, 6000)
    assert abs((found[0] == found[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    alone = neardup.dart_signatures(row[80:] - 1, names[30:], other, 1, 6000)
    assert (alone[0] == found[1]).all()


def test_similarities_are_exact():
    texts = ["a b c d e f g", "a b c d e f h", "a b", "a b", None, "x " * 30]
    left, right = zip(*((s, t) for s in texts for t in texts), strict=True)
    found = neardup.similarities(pa.array(left), pa.array(right))
    for s, t, value in zip(left, right, found, strict=True):
        a, b = brute.shingles(s), brute.shingles(t)
        assert value == pytest.approx((a & b).total() / max((a | b).total(), 1))


def test_components(spark):
    rng = random.Random(4)
    edges = [(a, a + 1) for a in range(0, 40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(30)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    found = {r.node: r.label for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: x for e in edges for x in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert found == want


def groups(pairs):
    out = defaultdict(list)
    for name, member in pairs:
        out[name].append(member)
    return sorted(map(sorted, out.values()))


def test_near_duplicates_of_odd_rows(odd, none):
    rows = [(i, t) for i, t, *_ in brute.odd_rows()]
    found = Counter((r.doc_id, r.class_id) for r in neardup.near_duplicates(odd).collect())
    assert found == Counter(
        {(1, 1): 1, (2, 1): 2, (None, 1): 1, (3, 1): 1, (12, 12): 1, (4, 4): 1, (5, 5): 1, (6, 6): 1, (None, None): 1,
         (7, 7): 1, (8, 8): 1, (9, 8): 1, (10, 10): 1, (11, 11): 1}
    )
    kept = neardup.drop_near_duplicates(odd)
    assert kept.schema == odd.schema
    wordless = [i for i, t in rows if not brute.words(t)]
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 7, 8, 10, 11, 12, *wordless])
    assert neardup.near_duplicates(none).count() == 0


def test_links_between_classes_of_a_bucket_are_found(spark):
    """A chain of texts around one another, of which no single one is near all others."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for k in range(60):
        own = list(base)
        for _ in range(rng.randrange(1, 6)):
            own[rng.randrange(120)] = f"e{k}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    want = brute.classes(rows)
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert groups((r.class_id, r.doc_id) for r in found) == groups((str(want[i]), i) for i, _ in rows)
    texts = pa.array(texts)
    size = len(texts)
    half = np.arange(size) % 2
    inside = neardup.block_links(texts, np.arange(size), np.zeros(size, np.int64), 0.8)
    across = neardup.block_links(texts, np.arange(size), half, 0.8)
    assert all(half[a] != half[b] for a, b in across) and len(inside) < size


def test_tokens_of_any_script_equal_brute_force():
    texts = [
        "“Smart” quotes—long dashes… and\u00a0no-break\u202fspaces", "don’t don't", "x²½ Ⅳ ﬁne ＦＵＬＬ", "soft\u00adhyphen", None, "",
        "他说：「人工智能是未来」。ok", "カード を 使う", "ภาษาไทย abc", "cafe\u0301 caf\u00e9", "日本2024年 и Привет", "plain, ascii_text 12", "a\u200bb",
    ]
    found = []
    for lo, hi, words in tiling.tokens(pa.array(texts)):
        found += [words.hash[words.first[k] : words.first[k + 1]].tolist() for k in range(hi - lo)]
    names = {}
    for text, hashes in zip(texts, found, strict=True):
        want = brute.tokens(text)
        assert len(want) == len(hashes), text
        assert all(names.setdefault(w, h) == h for w, h in zip(want, hashes, strict=True))
    assert len(set(names.values())) == len(names)


def test_quoted_passages_are_found_in_any_typography(spark):
    own = "the quick brown fox jumps over a lazy dog while seven wizards mix some strange potions".split()
    chinese = "人工智能正在改变我们的生活方式"
    texts = [" ".join(own), "“" + "” “".join(own) + "”", "—".join(own), "\u00a0".join(own), f"他说过{chinese}这样的话", "别的句子"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(own)), (1, chinese)], "item_id long, text string")
    for most in (tiling.BROADCAST_BYTES, 0):
        found = {tuple(r) for r in tiling.contaminated(docs, bench, broadcast_bytes=most).collect()}
        assert found == {(k, 0, 16, 16, 1) for k in range(4)} | {(4, 1, 15, 15, 1)}


def test_tiles_equal_brute_force():
    rng = random.Random(6)
    for _ in range(400):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 25))]
        text = [rng.randrange(5) for _ in range(rng.randrange(40))]
        least = rng.randrange(1, 5)
        found = tiling.greedy_tiles(np.array(item, np.uint64), np.array(text, np.uint64), least)
        assert found == brute.tiles(item, text, least)


@pytest.mark.parametrize("most", [tiling.BROADCAST_BYTES, 0])
def test_contamination_by_either_join(spark, odd, none, most):
    item = "The quick brown fox jumps over the lazy dog while seven wizards mix strange potions tonight"
    own = item.split()
    texts = [
        (1, "before " + item.upper() + ", after"), (2, " ".join(own[8:] + ["and"] + own[:8])), (3, " ".join(own[:6])),
        (4, None), (5, ""), (None, item), (7, item), (7, item), (8, "tiny set"), (9, " ".join(own[:8]) + " filler " * 3000),
    ]
    items = [(1, item), (1, item), (2, "tiny set"), (3, None), (4, "..."), (None, own[0])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, item_id string, n_tiles int")
    bench = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    want = brute.contamination([t for _, t in texts], [t for _, t in items])
    found = tiling.contaminated(docs, bench, broadcast_bytes=most).collect()
    assert Counter(map(tuple, found)) == Counter((texts[a][0], items[k][0], *v) for (a, k), v in want.items())
    assert {a for a, k in want if k == 0} == {0, 1, 5, 6, 7, 9}
    left = tiling.drop_contaminated(docs, bench, broadcast_bytes=most)
    assert left.schema == docs.schema
    assert Counter(r.text for r in left.collect()) == Counter(
        t for k, (_, t) in enumerate(texts) if k not in {a for a, _ in want}
    )
    nothing = bench.where("false")
    assert tiling.contaminated(docs, nothing, broadcast_bytes=most).count() == 0
    assert tiling.drop_contaminated(odd, nothing, broadcast_bytes=most).count() == odd.count()
    assert tiling.contaminated(none, bench, broadcast_bytes=most).count() == 0


@pytest.mark.parametrize("phrase", ["buy now", "click here", "click here to win", "one of these days we will"])
def test_each_length_can_reject(phrase):
    """Phrases of two to six words between words that change leave no longer n-gram repeated."""
    text = " ".join(f"{phrase} w{k}x{k * k}" for k in range(60))
    found = {k: v[0] for k, v in repetition.measure(pa.array([text])).items()}
    n = len(phrase.split())
    assert found[f"top_chars_{n}" if n < 5 else f"dup_chars_{n}"] > 0 and not found["kept"] and not found["base_failed"]
    assert all(found[f"dup_chars_{m}"] == 0 for m in range(max(5, n + 1), 11))


def test_a_footer_equal_to_the_header_stays():
    line = "all rights reserved by the makers of this page"
    body = " ".join(f"v{k * k}" for k in range(300))
    assert repetition.measure(pa.array([f"{line}\n{body}\n{line}"]))["kept"][0]

"""Packing, chat windows and byte-pair encoding."""

import random
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tickframe.llm import bpe, packing, windows
from tickframe.llm.queries import TOKENIZER

from . import brute


def test_tree_is_balanced_and_finds_the_tightest():
    rng = random.Random(1)

    def height(node):
        if node is None:
            return 0
        a, b = height(node[1]), height(node[2])
        assert abs(a - b) <= 1 and node[3] == 1 + max(a, b)
        return node[3]

    for _ in range(30):
        tree, keys = packing.Tree(), []
        for k in range(200):
            if keys and rng.random() < 0.45:
                key = keys.pop(rng.randrange(len(keys)))
                tree.remove(key)
            else:
                insort(keys, key := (rng.randrange(50), k))
                tree.insert(key)
            asked = (rng.randrange(55), -1)
            place = bisect_left(keys, asked)
            assert tree.at_least(asked) == (keys[place] if place < len(keys) else None)
        height(tree.root)


def plain_best_fit(sizes, capacity):
    bins, place = [], {}
    for name, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        fits = [(r, k) for k, r in enumerate(bins) if r >= size]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append(max(capacity, size))
        bins[k] -= size
        place[name] = k
    return place


def test_best_fit_decreasing_equals_brute_force():
    rng = random.Random(2)
    for _ in range(100):
        sizes = {k: rng.randrange(1, 40) for k in range(rng.randrange(60))}
        capacity = rng.randrange(5, 60)
        assert packing.best_fit_decreasing(sizes, capacity) == plain_best_fit(sizes, capacity)
        place, most = packing.pack(sizes, 8)
        load = Counter()
        for name, k in place.items():
            load[k] += sizes[name]
        assert max(place.values(), default=0) < 8 and max(load.values(), default=0) <= most
        assert most <= max(2 * -(-sum(sizes.values()) // 8), max(sizes.values(), default=0) * 2)


def check_shards(rows, found, shards=8):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(
        (i, len((t or "").encode()) + 1, brute.zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


def test_shards(spark, odd, none, documents):
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    found = packing.text_shards(docs).collect()
    check_shards(documents, found)
    load, where = Counter(), defaultdict(set)
    texts = dict(documents)
    for r in found:
        load[r.shard] += r.size
        where[texts[r.doc_id]].add(r.shard)
    assert max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 8
    assert all(len(s) == 1 for s in where.values())
    check_shards([(i, t) for i, t, *_ in brute.odd_rows()], packing.text_shards(odd).collect())
    assert packing.text_shards(none).count() == 0


CHAT = "conv string, idx int, conv_id long, turn long, role string, text string, window string, loss int"


def chat(spark):
    tricky = ["</turn>", "<turn =user>x", "\\l \\b \\\\", "<", "\\", "", None, "a\n\nb", "ü 漢 </turn", " <turn ~"]
    rng = random.Random(3)
    rows = [(c, k, rng.choice(["user", "assistant"]), rng.choice(tricky)) for c in range(6) for k in range(9)]
    rows += [(10, 0, "system", "be <kind>"), (10, 1, "user", "hi"), (10, 2, "assistant", "ho")]
    rows += [(11, 0, "system", "alone"), (12, 0, None, "no role"), (12, None, "assistant", "no turn"), (12, 0, "a>b<c\\", "odd")]
    rows += [(None, 1, "assistant", "lost"), (None, 0, "user", "found"), (13, 0, "assistant", "same"), (13, 0, "assistant", "same")]
    rows += [(14, 0, "system", "s " * 30)]
    rows += [(14, k, ["assistant", "user"][k % 2], f"t{k} " * rng.randrange(40)) for k in range(1, 60)]
    rows += [(14, 60, "assistant", "long " * 700), (14, 61, "user", "end")]
    return rows, spark.createDataFrame([("x", 1, *r, "y", 2) for r in rows], CHAT)


@pytest.mark.parametrize("budget, history", [(512, 128), (64, 16), (40, 0)])
def test_windows_read_back(spark, budget, history):
    rows, frame = chat(spark)
    made = windows.budgeted_windows(frame, budget=budget, history=history)
    found = {r.conv_id: r for r in windows.conversation_digests(made).collect()}
    made = made.collect()
    by_conv = defaultdict(list)
    for c, k, role, text in rows:
        by_conv[c].append((k is not None, k or 0, role or "", text or ""))
    assert set(found) == set(by_conv)
    for c, turns in by_conv.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(text for role, text in turns if role == "assistant")
        r = found[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == brute.sha("".join(f"{role}\n{text}\n" for role, text in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), brute.sha(loss))
        assert r.formatted_chars == sum(len(w.text) for w in made if w.conv_id == c)
    for w in made:
        turns = w.text.split(windows.CLOSE)[:-1]
        assert all(t.startswith(("<turn =", "<turn ~")) and t.count("<") == 1 for t in turns)
        words = sum(len(brute.words(t.partition(">")[2])) + windows.MARKERS for t in turns)
        assert w.n_tokens == words and w.over_budget == (words > budget)
        fresh = [t for t in turns if t.startswith("<turn =")]
        # beyond the budget go only single turns that are too long themselves
        assert not w.over_budget or len(fresh) - ("<turn =system>" in w.text) <= 1
    long = [w for w in made if w.conv_id == 14]
    assert all("system>" in w.text for w in long) and sum("<turn =system>" in w.text for w in long) == 1
    assert (history > 0) == any("<turn ~user>" in w.text or "<turn ~assistant>" in w.text for w in long)


def test_windows_of_nothing(spark):
    _, frame = chat(spark)
    assert windows.conversation_digests(windows.budgeted_windows(frame.where("false"))).count() == 0


def test_windows_run_without_python(spark, capsys):
    _, frame = chat(spark)
    windows.conversation_digests(windows.budgeted_windows(frame)).explain()
    assert not any(name in capsys.readouterr().out for name in ("Python", "Pandas", "Arrow"))


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(TOKENIZER)


def random_texts(n, seed):
    rng = random.Random(seed)
    far = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x300), rng.randrange(0x300, 0x3000)]))
    odd = ["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "a", "İ", "Σ", "ς", "ﬁ", "é", "\0", "\1x", "Ⱦ", "'s", "\x1c"]
    parts = ["a", "aa", "b", "ab", "re", "'S", "ed", "ing", "the", "th", "7", " ", "!", "\n"]
    for _ in range(n):
        kind = rng.randrange(3)
        yield "".join(far() if kind == 0 else rng.choice((odd, parts)[kind - 1]) for _ in range(rng.randrange(40)))


def test_encoding_equals_the_library(encoder, documents):
    texts = [None, "", *random_texts(6000, 4), *(t for _, t in documents)]
    ids = encoder.encode(pa.array(texts, pa.string()))
    decoded = encoder.decode(ids)
    for text, own, back in zip(texts, ids.to_pylist(), decoded.to_pylist(), strict=True):
        assert (own, back) == brute.encoded(text)


def test_speculation_is_checked(encoder):
    """Some greedy guesses fail the check; all that pass are what exact merging yields."""
    words = sorted({w for _, t in enumerate(random_texts(300, 5)) for w in t.split() if w.isalpha() and w.isascii()})
    words += ["thatintention", "heringsinthe", "unbelievablenesses", "rethereing"]
    failed = 0
    for w in sorted({w.lower() for w in words}):
        guess, exact = encoder.greedy(w), encoder.merge(w)
        pairs = bpe.np.array(guess)
        sound = bool(encoder.valid[guess].all() and encoder.compatible(pairs[:-1], pairs[1:]).all())
        assert sound == (guess == exact)
        failed += not sound
    assert failed


def test_memo_may_start_anew(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 5)
    for text in ["one two three four", "five six seven eight", "one nine"]:
        assert encoder.encode(pa.array([text])).to_pylist() == [brute.encoded(text)[0]]


def test_encode_odd_rows(spark, odd, none):
    both = bpe.decode(bpe.encode(odd, TOKENIZER), TOKENIZER)
    assert both.columns == [*odd.columns, "ids", "decoded"]
    assert sorted((r.text or "", r.ids, r.decoded) for r in both.collect()) == sorted(
        (t or "", *brute.encoded(t)) for _, t, *_ in brute.odd_rows()
    )
    assert bpe.decode(bpe.encode(none, TOKENIZER), TOKENIZER).count() == 0
    once = bpe.encode(odd, TOKENIZER, decoded_col="decoded")
    assert once.columns == both.columns and sorted(map(str, once.collect())) == sorted(map(str, both.collect()))
    again = bpe.encode(both, TOKENIZER)
    assert again.columns.count("ids") == 1
    nothing = both.selectExpr("doc_id", "cast(null as array<int>) as ids").limit(1)
    assert bpe.decode(nothing, TOKENIZER).first().decoded == ""

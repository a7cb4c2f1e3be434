"""Byte-pair encoding by speculation: greedy tokens, checked pairwise, merged exactly only on failure.

A sequence of tokens is what merging yields if every token is what merging yields for its
own characters and no merge across any boundary would have come first. Both are tested
for all adjacent pairs of a batch at once by undoing merges, latest first, on the two
sides of the boundary.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</w>"
NEVER = 1 << 60
#: Words a worker remembers; beyond that it starts anew. Results don't depend on it.
MEMO_WORDS = 1 << 18


def _ranges(kinds: str) -> str:
    """Code points below U+0310 of some general categories, as a character class."""
    return "".join(f"\\u{c:04x}" for c in range(0x310) if unicodedata.category(chr(c))[0] in kinds)


_SPACES = r"\t-\r \x85\xa0"
#: The tokenizer's pattern for texts below U+0200, where NFC changes nothing; lower case stays below U+0310.
_PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_ranges('L')}]+|[{_ranges('N')}]|[^{_SPACES}{_ranges('LN')}]+"
)
_FAR = re.compile("[^\\u0000-\\u01ff]")
#: Marks in the memo that no text can hold: a special token; a piece already in byte characters.
_SPECIAL, _BYTES = "\ud800", "\ud801"


@cache
def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies (fixed rule)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """One tokenizer file: a BPE vocabulary over bytes with an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [tuple(m) for m in spec["model"]["merges"]]
        self.vocab, self.size = vocab, max(vocab.values()) + 1
        library = Tokenizer.from_file(path)
        self.normal, self.pieces = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        names = [""] * max(self.size, 1 + max(self.special.values(), default=0))
        for text, k in (*vocab.items(), *self.special.items()):
            names[k] = text
        self.names = pa.array(names)
        self.longest = max(map(len, vocab))
        self.left, self.right = np.full(self.size, -1), np.full(self.size, -1)
        self.rank = np.full(self.size, -1)
        self.merged = {}  # pair: rank and whole
        for r, (a, b) in enumerate(merges):
            whole = vocab[a + b]
            self.left[whole], self.right[whole], self.rank[whole] = vocab[a], vocab[b], r
            self.merged[vocab[a], vocab[b]] = (r, whole)
        keys = np.array([a * self.size + b for a, b in self.merged])
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merged.values()])[order]
        self.valid = self._valid_tokens()
        self.byte_table = _byte_characters()
        self.forget()

    def forget(self) -> None:
        """Empty the memo: word numbers, and the tokens of all words end to end."""
        self.number: dict[str, int] = {}
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[place] == key, self.pair_ranks[place], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | int = NEVER) -> np.ndarray:
        """Whether merging keeps the boundary between adjacent tokens ``a`` and ``b``.

        ``before`` limits the test to merges of a smaller rank. Times are twice the rank, so
        that a merge left of another one of the same rank comes first.
        """
        a, b = a.copy(), b.copy()
        good, live = np.ones(len(a), bool), np.arange(len(a))
        time = np.broadcast_to(np.asarray(before, np.int64) * 2, a.shape).copy()
        while len(live):
            x, y = a[live], b[live]
            crossed = 2 * np.minimum(self._pair_rank(x, y), NEVER) < time[live]
            good[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_right = (ry >= rx) & (ry >= 0)
            undo_left = rx > ry
            go, right = live[undo_right], y[undo_right]
            time[go], b[go] = 2 * ry[undo_right] + 1, self.left[right]
            go, left = live[undo_left], x[undo_left]
            time[go], a[go] = 2 * rx[undo_left], self.right[left]
            live = live[~crossed & (undo_right | undo_left)]
        return good

    def _valid_tokens(self) -> np.ndarray:
        """Tokens that merging yields for their own characters."""
        made = np.flatnonzero(self.rank >= 0)
        good = np.ones(self.size, bool)
        good[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])]:  # parts come before the whole
            good[t] &= good[self.left[t]] and good[self.right[t]]
        return good

    def greedy(self, word: str) -> list[int] | None:
        """The longest token that fits, again and again; none if the end can't be reached."""
        vocab, n, at, out = self.vocab, len(word), 0, []
        while at < n:
            last = vocab.get(word[at:] + END)
            if last is not None:
                out.append(last)
                return out
            for stop in range(min(n - 1, at + self.longest), at, -1):
                token = vocab.get(word[at:stop])
                if token is not None:
                    out.append(token)
                    at = stop
                    break
            else:
                return None
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging: the pair of lowest rank, leftmost first, until no pair merges."""
        parts = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + END]]
        known, never = self.merged.get, (NEVER, -1)
        pairs = [known(pair, never) for pair in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best is never:
                break
            k = pairs.index(best)
            parts[k : k + 2] = [best[1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = known((parts[k], parts[k + 1]), never)
            if k:
                pairs[k - 1] = known((parts[k - 1], parts[k]), never)
        return parts

    def _letters(self, word: str) -> str:
        if word[0] == _BYTES:
            return word[1:]
        return word.encode().decode("latin-1").translate(self.byte_table)

    def learn(self, words: list[str]) -> None:
        """Encode words the memo lacks."""
        special = [w for w in words if w[0] == _SPECIAL]
        self._remember(special, np.ones(len(special), np.int64), np.array([self.special[w[1:]] for w in special], np.int64))
        words = [w for w in words if w[0] != _SPECIAL]
        letters = [self._letters(w) for w in words]
        guesses = [self.greedy(w) for w in letters]
        sizes = np.array([len(g or ()) for g in guesses], np.int64)
        flat = np.array([t for g in guesses for t in g or ()], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        bad = sizes == 0
        bad[owner[~self.valid[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)
        bad[owner[inner[~good[which]]]] = True
        for k in np.flatnonzero(bad).tolist():
            guesses[k] = self.merge(letters[k])
        if bad.any():
            sizes = np.array([len(g) for g in guesses], np.int64)
            flat = np.array([t for g in guesses for t in g], np.int64)
        self.failed = int(bad.sum())
        self._remember(words, sizes, flat)

    def _remember(self, words: list[str], sizes: np.ndarray, flat: np.ndarray) -> None:
        base = len(self.number)
        self.number.update(zip(words, range(base, base + len(words)), strict=True))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(sizes)))
        self.flat = np.concatenate((self.flat, flat.astype(np.int32)))

    def words_of(self, text: str) -> list[str]:
        """The pieces of a text that are merged on their own, or marked special tokens."""
        if not any(s in text for s in self.special):
            return self._plain_words(text)
        out = []
        for k, part in enumerate(self.split.split(text)):
            out.extend([_SPECIAL + part] if k % 2 else self._plain_words(part))
        return out

    def _plain_words(self, text: str) -> list[str]:
        if _FAR.search(text) is None:
            return _PIECES.findall(text.lower())
        # elsewhere the library's own tables decide what is a letter
        return [_BYTES + piece for piece, _ in self.pieces(self.normal(text))]

    def encode(self, column: pa.Array) -> pa.ListArray:
        """Token ids of every text; a null text has none."""
        pieces = [self.words_of(t) if t else [] for t in column.to_pylist()]
        missing = sorted(set().union(*pieces).difference(self.number))
        if len(self.number) + len(missing) > MEMO_WORDS:
            self.forget()
            missing = sorted(set().union(*pieces))
        self.learn(missing)
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        number = np.fromiter((self.number[w] for p in pieces for w in p), np.int64, int(counts.sum()))
        size = self.first[number + 1] - self.first[number]
        ends = np.concatenate(([0], np.cumsum(size)))
        place = np.repeat(self.first[number] - ends[:-1], size) + np.arange(ends[-1])
        offsets = ends[np.concatenate(([0], np.cumsum(counts)))]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(self.flat[place]))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The tokens' strings joined by one space, as the library decodes without a decoder."""
        flat = self.names.take(ids.flatten())
        starts = ids.offsets
        base = starts[0].as_py()
        lists = pa.ListArray.from_arrays(pc.subtract(starts, base) if base else starts, flat)
        return pc.binary_join(lists, " ")


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(
    docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None
) -> DataFrame:
    """All columns and the token ids of every whole text as ``ids_col`` (replaced if it is there).

    ``decoded_col`` adds the text decoded from the ids again in the same pass.

    ``tokenizer`` is the path of a file that every executor has: BPE over bytes with an
    end-of-word suffix, no post-processor. Strings of special tokens inside texts become
    special tokens, as by default in the library. Null and empty texts have no tokens.
    """
    source = docs.drop(*({ids_col, decoded_col} - {None, text_col}))
    place = source.columns.index(text_col)
    added = [ids_col] if decoded_col is None else [ids_col, decoded_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = encoder(tokenizer).encode(batch.column(place))
            found = [ids] if decoded_col is None else [ids, encoder(tokenizer).decode(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *added])
        encoder(tokenizer).forget()  # the worker lives on and has other tasks to do

    kinds = [F.lit(None).cast(t).alias(n) for n, t in zip(added, ("array<int>", "string"), strict=False)]
    return source.mapInArrow(run, source.select("*", *kinds).schema)


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns and the decoded text as ``text_col``; null ids decode to the empty text."""
    source = encoded.drop(text_col).withColumn(ids_col, F.coalesce(ids_col, F.array().cast("array<int>")))
    place = source.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = encoder(tokenizer).decode(batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, text_col])

    return source.mapInArrow(run, source.select("*", F.lit(None).cast("string").alias(text_col)).schema)


def digests(ids_col: str = "ids", text_col: str = "decoded") -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded rows."""
    return [
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col(ids_col).cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col(text_col), 256).alias("decoded_sha256"),
    ]

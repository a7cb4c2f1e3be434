"""Language of a text from a bidirectional gated recurrent network over bytes, in NumPy.

Texts become lower-case bytes in which every run of ASCII characters other than letters
is one space, cut into windows. The network reads each window in both directions and
labels every byte with probabilities of the languages; a document's are the mean over its
letters. It is trained on the driver by backpropagation through time on a bounded sample.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm import words as W

#: Bytes the network reads at once, and units in each direction.
WINDOW, UNITS = 64, 8
#: Languages that these units and ``STEPS`` are meant for (more languages get more of both),
#: distinct texts of each in the sample, and windows of each sampled text.
LANGUAGES, SAMPLE_DOCS, SAMPLE_WINDOWS = 64, 300, 4
STEPS, BATCH, RATE, SEED = 260, 192, 0.015, 7
UNKNOWN = "und"

_LETTER = ~W.NOT_ALNUM & ~np.array([chr(b).isdigit() and b < 128 for b in range(256)])


def windows(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``WINDOW`` bytes of the normalised texts, 0 beyond their ends; row and letters of each."""
    letter = _LETTER[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other byte after a letter becomes a space
    cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
    keep[cut] = letter[cut]
    text = np.where(letter, raw, np.uint8(32))[keep]
    size = W.row_sums(keep, at)
    count = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), count)
    first = np.concatenate(([0], np.cumsum(count)))
    begin = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(first[-1] * WINDOW, np.uint8)
    out[np.arange(len(text)) + np.repeat(first[:-1] * WINDOW - begin[:-1], size)] = text
    out = out.reshape(-1, WINDOW)
    return out, row, (out != 0) & (out != 32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, np.float32(0.5), out=x)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


@dataclass
class Network:
    """Weights: inputs by byte (256, 3H), recurrent (H, 2H) and (H, H) for two directions; output layer."""

    languages: list[str]
    params: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], units: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        params = {}
        for d in "fb":
            params[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * units))
            params[f"x{d}"][:, units : 2 * units] -= 1.0  # remember by default
            params[f"u{d}"] = rng.normal(0, units**-0.5, (units, 2 * units))
            params[f"c{d}"] = rng.normal(0, units**-0.5, (units, units))
        params["o"] = rng.normal(0, 0.3, (2 * units, len(languages)))
        params["bias"] = np.zeros(len(languages))
        return cls(languages, {k: v.astype(np.float32) for k, v in params.items()})

    def states(self, text: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states, time first, of windows given time first; inner values go to ``keep``."""
        x, u, c = (self.params[k + d] for k in "xuc")
        h = np.zeros((text.shape[1], len(c)), np.float32)
        n = len(c)
        out = np.empty((len(text), *h.shape), np.float32)
        for t in range(len(text)) if d == "f" else reversed(range(len(text))):
            given = x[text[t]]
            gates = h @ u
            gates += given[:, : 2 * n]
            gates = _sigmoid(gates)
            reset, update = gates[:, :n], gates[:, n:]
            product = h @ c
            fresh = product * reset
            fresh += given[:, 2 * n :]
            np.tanh(fresh, out=fresh)
            if keep is not None:
                keep.append((t, h, reset, update, product, fresh))
            step = fresh - h
            step *= update
            h = np.add(h, step, out=out[t])
        return out

    def probabilities(self, text: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at every byte: (time, window, language)."""
        n = len(self.params["cf"])
        logits = self.states(text, "f") @ self.params["o"][:n]
        logits += self.states(text, "b") @ self.params["o"][n:]
        logits += self.params["bias"]
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def gradients(self, text: np.ndarray, label: np.ndarray, letters: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy at letters, by backpropagation through time."""
        kept = {"f": [], "b": []}
        states = {d: self.states(text, d, kept[d]) for d in "fb"}
        n = len(self.params["cf"])
        joined = np.concatenate((states["f"], states["b"]), 2)
        logits = joined @ self.params["o"] + self.params["bias"]
        error = np.exp(logits - logits.max(-1, keepdims=True))
        error /= error.sum(-1, keepdims=True)
        error[:, np.arange(text.shape[1]), label] -= 1
        error *= letters[:, :, None] / np.float32(max(letters.sum(), 1))
        out = {"o": np.tensordot(joined, error, ([0, 1], [0, 1])), "bias": error.sum((0, 1))}
        back = error @ self.params["o"].T
        for d, part in (("f", back[:, :, :n]), ("b", back[:, :, n:])):
            u, c = self.params["u" + d], self.params["c" + d]
            dx, du, dc = np.zeros_like(self.params["x" + d]), np.zeros_like(u), np.zeros_like(c)
            dh = np.zeros_like(part[0])
            for t, h, reset, update, product, fresh in reversed(kept[d]):
                dh = dh + part[t]
                dfresh = dh * update * (1 - fresh * fresh)
                dgates = np.concatenate(
                    (dfresh * product * reset * (1 - reset), dh * (fresh - h) * update * (1 - update)), 1
                )
                dproduct = dfresh * reset
                np.add.at(dx, text[t], np.concatenate((dgates, dfresh), 1))
                du += h.T @ dgates
                dc += h.T @ dproduct
                dh = dh * (1 - update) + dgates @ u.T + dproduct @ c.T
            out |= {"x" + d: dx, "u" + d: du, "c" + d: dc}
        return out


def some_windows(column: pa.Array) -> list[bytes]:
    """Up to ``SAMPLE_WINDOWS`` windows of each text, end to end: those with the smallest hashes."""
    out = []
    for lo, hi, raw, at in W.chunks(pc.utf8_lower(column)):
        text, row, _ = windows(raw, at)
        edges = np.arange(len(text)) * WINDOW
        order = np.lexsort((W.span_hashes(text.ravel(), edges, edges + WINDOW), row))
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        pick = order[rank < SAMPLE_WINDOWS]
        ends = np.searchsorted(row[pick], np.arange(hi - lo + 1))
        out += [text[pick[ends[k] : ends[k + 1]]].tobytes() for k in range(hi - lo)]
    return out


def train(samples: list[bytes], langs: list[str], units: int = UNITS, steps: int = STEPS, seed: int = SEED) -> Network:
    """A network for the languages of the sampled windows, by Adam with a falling rate."""
    languages = sorted(set(langs))
    net = Network.fresh(languages, units, seed)
    rng = np.random.default_rng(seed)
    text = np.frombuffer(b"".join(samples), np.uint8).reshape(-1, WINDOW)
    code = {name: k for k, name in enumerate(languages)}
    label = np.repeat([code[name] for name in langs], [len(s) // WINDOW for s in samples])
    letter = (text != 0) & (text != 32)
    if len(languages) < 2 or not len(text):
        return net
    # every language weighs the same: windows are drawn by language, then within it
    groups = [g for g in (np.flatnonzero(label == k) for k in range(len(languages))) if len(g)]
    first = {k: np.zeros_like(v) for k, v in net.params.items()}
    second = {k: np.zeros_like(v) for k, v in net.params.items()}
    for step in range(1, steps + 1):
        chosen = np.array([g[rng.integers(len(g))] for g in (groups[k] for k in rng.integers(len(groups), size=BATCH))])
        found = net.gradients(text[chosen].T, label[chosen], letter[chosen].T.astype(np.float32))
        norm = np.sqrt(sum(float((g * g).sum()) for g in found.values()))
        rate = RATE * (1 - step / (steps + 1))
        for k, g in found.items():
            g = g / max(1.0, norm)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.params[k] -= (
                rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            ).astype(np.float32)
    return net


def pooled(net: Network, column: pa.Array, batch: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: mean probabilities over its letters, letters, and how many letters each language wins."""
    sums, counts, wins = [], [], []
    k = len(net.languages)
    batch = batch or max(1024 * LANGUAGES // max(k, LANGUAGES), 1)  # bounds memory
    for lo, hi, raw, at in W.chunks(pc.utf8_lower(column)):
        text, row, letters = windows(raw, at)
        total, count, won = np.zeros((hi - lo, k)), np.zeros(hi - lo, np.int64), np.zeros((hi - lo, k), np.int64)
        for at_ in range(0, len(text), batch):
            part = np.ascontiguousarray(text[at_ : at_ + batch].T)
            mask, rows = letters[at_ : at_ + batch].T, row[at_ : at_ + batch]
            p = net.probabilities(part)
            label = p.argmax(-1)
            p *= mask[:, :, None]
            np.add.at(total, rows, p.sum(0))
            np.add.at(count, rows, mask.sum(0))
            for lang in range(k):
                np.add.at(won[:, lang], rows, ((label == lang) & mask).sum(0))
        sums.append(total)
        counts.append(count)
        wins.append(won)
    if not sums:
        return np.zeros((0, k)), np.zeros(0, np.int64), np.zeros((0, k), np.int64)
    count = np.concatenate(counts)
    return np.concatenate(sums) / np.maximum(count, 1)[:, None], count, np.concatenate(wins)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """Train on a sample of the documents with a language: ``sample_docs`` distinct texts of each, or all it has.

    Texts are chosen by their hash and windows by a hash of their bytes, so the sample is the
    same however rows are dealt and however often a text is repeated. Every language that
    occurs is learned; the sample grows with their number, not with the table.
    """
    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where("text is not null and lang is not null").withColumn("hash", F.xxhash64("text"))
    counts = known.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    counts = docs.sparkSession.createDataFrame(counts.collect(), "lang string, n long")
    # twice the texts wanted, so that none of the languages has too few by chance
    known = known.join(F.broadcast(counts), "lang")
    drawn = (F.abs(F.col("hash") % 1_000_000_007) / 1_000_000_007).alias("drawn")
    chosen = known.select("lang", drawn, "text").where(F.col("drawn") < 2.0 * sample_docs / F.col("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(some_windows(batch.column(2)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["lang", "drawn", "windows"])

    few = chosen.mapInArrow(run, "lang string, drawn double, windows binary").distinct().orderBy("drawn", "lang", "windows")
    samples, langs, seen = [], [], Counter()
    for r in few.collect():
        seen[r["lang"]] += 1
        if seen[r["lang"]] <= sample_docs:
            samples.append(bytes(r["windows"]))
            langs.append(r["lang"])
    grown = max(1.0, len(seen) / LANGUAGES)
    return train(samples, langs, math.ceil(UNITS * math.sqrt(grown)), math.ceil(STEPS * grown)) if samples else None


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred, score, letters, agreement of every whole text.

    score is the pooled probability of lang_pred; agreement the share of letters that are
    labelled with it one by one. A text that is null or has no letter gets ``und``, score 0,
    and so does every text if there is no network. Of equal probabilities the first language
    by name wins. Other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = batch.column(1), batch.num_rows
            names, score, agree = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n)
            letters = np.zeros(n, np.int64)
            if net is not None and n:
                p, letters, won = pooled(net, texts)
                best = p.argmax(1)
                fine = letters > 0
                # bytes beyond ASCII count as letters above; texts of nothing else are looked at closely
                plain = pc.match_substring_regex(texts, "[a-zA-Z]").fill_null(False).to_numpy(zero_copy_only=False)
                for k in np.flatnonzero(fine & ~plain).tolist():
                    fine[k] = any(map(str.isalpha, texts[k].as_py()))
                names[fine] = np.array(net.languages, object)[best[fine]]
                score[fine] = np.minimum(p[fine, best[fine]], 1.0)
                agree[fine] = won[fine, best[fine]] / letters[fine]
                letters = np.where(fine, letters, 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(letters), pa.array(agree)],
                [id_col, "lang_pred", "score", "letters", "agreement"],
            )

    return source.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, letters long, agreement double")

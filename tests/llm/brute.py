"""Plain Python versions of the operators, and documents with odd rows."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import regex
from tokenizers import Tokenizer

from tickframe.llm import kneser_ney, rulefit
from tickframe.llm.queries import TOKENIZER

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept int, n_words string, label string, node string, id string, digest string, key string, score string, _id string, _digest string, _key string, _Word string, mass string"


def words(text):
    return WORDS.findall(text or "")


def odd_rows():
    """Null ids and texts, blanks, repeated rows, equal texts, a very long text, clashing columns."""
    plain = " ".join(f"w{k * k % 97}x{k}" for k in range(60))
    near = " ".join(f"w{k * k % 97}x{k}" if k != 30 else "changed" for k in range(60))
    long = " ".join(f"t{k * 7919 % 100_003}" for k in range(60_000))
    texts = [
        (1, plain), (2, plain), (2, plain), (None, plain), (3, near), (4, None), (5, ""), (6, " \n\t "), (None, None),
        (7, long), (8, "one two"), (9, "one two"), (10, "naïve Ünïcode — ﬁn 漢字"), (11, "line a b c\n" * 40),
        (12, plain + "\n" + plain),
    ]
    extra = (None, "s", 0, 1, "a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l")
    return [(i, t, *extra) for i, t in texts]


def repetition(text):
    text = text or ""
    own = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen, dup_chars = set(), 0
    for x in lines:
        dup_chars += len(x) if x in seen else 0
        seen.add(x)
    out = {
        "n_words": len(own), "word_chars": sum(map(len, own)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(seen), "dup_line_chars": dup_chars,
    }
    for n in range(2, 11):
        grams = [tuple(own[k : k + n]) for k in range(len(own) - n + 1)]
        count, first = Counter(grams), {g: k for k, g in reversed([*enumerate(grams)])}
        if n < 5:
            out[f"top_chars_{n}"] = max([(c - 1) * len("".join(g)) for g, c in count.items()], default=0)
            continue
        later = {q for k, g in enumerate(grams) if first[g] < k for q in range(k, k + n)}
        out[f"dup_chars_{n}"] = sum(len(own[q]) for q in later)
        if n == 8:
            out["n_repeat_words"] = len({q for k, g in enumerate(grams) if count[g] > 1 for q in range(k, k + n)})
    out["base_failed"] = len(own) < 20 or 100 * out["n_repeat_words"] > 30 * len(own)
    limits = {2: 20, 3: 18, 4: 16, 5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
    bad = any(100 * out[f"{'top' if n < 5 else 'dup'}_chars_{n}"] > x * out["word_chars"] for n, x in limits.items())
    bad = bad or 100 * out["n_dup_lines"] > 50 * len(lines) or 100 * dup_chars > 30 * out["word_chars"]
    out["kept"] = not (out["base_failed"] or bad)
    return out


def shingles(text):
    own = words(text)
    return Counter(tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))) if own else Counter()


def classes(rows, threshold=0.8):
    """Class of every row position: positions with chains of similar texts; wordless rows are alone."""
    by_text = defaultdict(list)
    for at, (_, text) in enumerate(rows):
        by_text[text].append(at)
    sets = {t: shingles(t) for t in by_text}
    sets = {t: s for t, s in sets.items() if s}
    holders = defaultdict(list)
    for t, s in sets.items():
        for g in s:
            holders[g].append(t)
    parent = {t: t for t in sets}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for t, s in sets.items():
        shared = Counter()
        for g, n in s.items():
            for other in holders[g]:
                shared[other] += min(n, sets[other][g])
        for other, n in shared.items():
            if other != t and n >= threshold * (s.total() + sets[other].total() - n) - 1e-9:
                parent[root(t)] = root(other)
    out = {}
    for t, places in by_text.items():
        for at in places:
            out[at] = ("class", root(t)) if t in sets else ("row", at)
    return out


def tiles(item, text, least):
    """Greedy string tiling by comparing every place with every other."""
    marked_item, marked_text, out = [False] * len(item), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while (
                    i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k]
                    and not marked_item[i + k] and not marked_text[j + k]
                ):
                    k += 1
                if k > best[2]:
                    best = (i, j, k)
        if best[2] < max(least, 1):
            return out
        out.append(best)
        for k in range(best[2]):
            marked_item[best[0] + k] = marked_text[best[1] + k] = True


def tokens(text):
    plain = re.sub("[\u00ad\u200c\u200d\u2060\ufeff]", "", unicodedata.normalize("NFKC", text or "")).lower()
    single = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
    return regex.findall(rf"{single}|(?:(?!{single})[\p{{L}}\p{{M}}\p{{N}}])+", plain)


def contamination(texts, items):
    """(position, item position): (tokens, covered, tiles) of pairs that share a seed and reach one half."""
    out = {}
    for k, item in enumerate(map(tokens, items)):
        least = min(5, len(item))
        seeds = {tuple(item[p : p + least]) for p in range(len(item) - least + 1)} if item else set()
        for at, text in enumerate(map(tokens, texts)):
            if not any(tuple(text[p : p + least]) in seeds for p in range(len(text) - least + 1)):
                continue
            found = tiles(item, text, least)
            covered = sum(n for _, _, n in found)
            if 100 * covered >= 50 * len(item):
                out[at, k] = (len(item), covered, len(found))
    return out


def kneser_ney_scorer(texts, order):
    """A function from a text to its counts, base score and score under interpolated modified Kneser-Ney."""
    begin, end = "<s>", "</s>"

    def own(text):
        return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words(text)] + [end]

    raw, top = Counter(), Counter()
    for t in texts:
        s = [begin] * (order - 1) + own(t)
        for k in range(order - 1, len(s)):
            top[tuple(s[k - order + 1 : k + 1])] += 1
            raw[s[k]] += 1
    counts, whole = {order: dict(top)}, {order: dict(top)}
    for m in range(order - 1, 0, -1):
        left, total = Counter(), Counter()
        for g in counts[m + 1]:
            left[g[1:]] += 1
        for g, n in whole[m + 1].items():
            total[g[1:]] += n
        counts[m] = {g: total[g] if g[0] == begin else left[g] for g in left}
        whole[m] = total
    cut = {m: (0, *kneser_ney.discounts([sum(c == k for c in counts[m].values()) for k in (1, 2, 3, 4)])) for m in counts}
    after = {m: defaultdict(lambda: [0, 0.0]) for m in counts}
    for m in counts:
        for g, n in counts[m].items():
            after[m][g[:-1]][0] += n
            after[m][g[:-1]][1] += cut[m][min(n, 3)]
    size, total = len(raw), raw.total()

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / (size + 1)
        if g[:-1] not in after[len(g)]:
            return lower
        n, held = after[len(g)][g[:-1]]
        c = counts[len(g)].get(g, 0)
        return max(c - cut[len(g)][min(c, 3)], 0) / n + held / n * lower

    def score(text):
        t = own(text)
        s = [begin] * (order - 1) + t
        base = sum(math.log10((raw[w] + 1) / (total + size + 1)) for w in t)
        value = sum(math.log10(p(tuple(s[k - order + 1 : k + 1]))) for k in range(order - 1, len(s)))
        return len(t), sum(raw[w] > 0 for w in t), total, base, value

    return score


def statistics(text):
    """The statistics of the rule ensemble, counted one by one."""
    text = text or ""
    own, lines = words(text), text.split("\n")
    share = lambda n, of: n / of if of else 0.0
    found = [sum(c in kinds for c in text) for kinds in ("#*$%&|<>", "|", "!?", ".,;:", "0123456789")]
    capitals = sum(unicodedata.category(c) == "Lu" for c in text)
    return [
        len(own), share(sum(map(len, own)), len(own)), *(share(n, len(text)) for n in (*found, capitals)),
        len(text) / len(lines), len(set(lines)) / len(lines), share(len(set(own)), len(own)),
    ]


def rule_score(ensemble, text):
    """Logistic function of the weights of the rules that hold."""
    value = dict(zip(rulefit.STATISTICS, statistics(text), strict=True))
    total = ensemble.intercept
    for rule, weight in ensemble.weights.items():
        total += weight * all(low < value[name] <= high for name, low, high in rule.bounds)
    return 1 / (1 + math.exp(-total))


def language_probabilities(net, text):
    """Mean over the letters of a text of the network's probabilities, byte by byte and window by window; letters."""
    raw = [b if b >= 128 or chr(b).isalpha() else 32 for b in (text or "").lower().encode()]
    kept = [b for k, b in enumerate(raw) if b != 32 or (k and raw[k - 1] != 32)]
    p = {k: v.astype(float) for k, v in net.params.items()}
    n, total, letters = len(p["cf"]), [0.0] * len(net.languages), 0
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for at in range(0, len(kept), 64):
        window = kept[at : at + 64] + [0] * (64 - len(kept[at : at + 64]))
        states = {}
        for d, order in (("f", range(64)), ("b", range(63, -1, -1))):
            h = [0.0] * n
            for t in order:
                x, u, c = p["x" + d][window[t]], p["u" + d], p["c" + d]
                reset = [sigmoid(x[k] + sum(h[j] * u[j, k] for j in range(n))) for k in range(n)]
                update = [sigmoid(x[n + k] + sum(h[j] * u[j, n + k] for j in range(n))) for k in range(n)]
                fresh = [math.tanh(x[2 * n + k] + reset[k] * sum(h[j] * c[j, k] for j in range(n))) for k in range(n)]
                h = [h[k] + update[k] * (fresh[k] - h[k]) for k in range(n)]
                states[d, t] = h
        for t, b in enumerate(window):
            if b in (0, 32):
                continue
            both = states["f", t] + states["b", t]
            odds = [math.exp(sum(x * w for x, w in zip(both, p["o"][:, k], strict=True)) + p["bias"][k]) for k in range(len(total))]
            total = [s + o / sum(odds) for s, o in zip(total, odds, strict=True)]
            letters += 1
    return [s / max(letters, 1) for s in total], letters


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


_library = Tokenizer.from_file(TOKENIZER)


def encoded(text):
    """Ids and decoded text by the tokenizer library."""
    ids = _library.encode(text or "", add_special_tokens=False).ids
    return ids, _library.decode(ids, skip_special_tokens=False)


SECRET = re.compile(
    r"AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{18}|(?<=PASSWORD=)[0-9A-F]{18}"
    r"|(?<=token = \")[0-9a-f]{40}|(?<=TOKEN = \")[0-9A-F]{40}"
)

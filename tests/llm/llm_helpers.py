from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from hemiciclo.llm import langid, toxicity

SF1, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text: str | None, size: int) -> set:
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(ids, links) -> dict:
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_links(texts: dict, size: int, percent: int = 80) -> list:
    sets = {i: shingles(t, size) for i, t in texts.items()}
    ids = sorted(i for i in sets if sets[i])
    out = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                out.append((a, b))
    return out


def terms_of(text):
    """Slots with their counts, one word and one hash at a time."""
    counts = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for k in [None, *(k for k in toxicity.BEGINNINGS if k < len(word))]:
            h = sum((ord(c) + 1) * pow(int(toxicity._BASE), i, 1 << 64) for i, c in enumerate(word[:k])) % (1 << 64)
            h ^= 0 if k is None else int(toxicity._PART)
            counts[((h ^ h >> 32) * int(toxicity._MIX)) % (1 << 64) >> 64 - toxicity.BITS] += 1
    return counts


def toxicity_scores(texts: dict, labels: dict) -> dict:
    """Neighbours and score of every text, from term counts, cosines and votes computed one by one."""
    counts = {i: terms_of(t) for i, t in texts.items()}
    n, df, cf = len(texts), Counter(), Counter()
    for c in counts.values():
        df.update(c.keys())
        cf.update(c)
    idf = {s: math.log((n + 1) / (d + 1)) for s, d in df.items()}
    weight = {s: idf[s] * (toxicity.EVEN + max(0.0, idf[s] + math.log(1 - math.exp(-cf[s] / n)))) for s in df}
    vectors = {}
    for i, c in counts.items():
        v = {s: k * weight[s] for s, k in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {s: x / size for s, x in v.items()} if size else {}
    examples = {i: int(y > 0) for i, y in labels.items() if y is not None and i in texts and zlib.crc32(str(i).encode()) % 3 != 1}
    base = (sum(examples.values()) + 0.5) / (len(examples) + 1)

    def voted(i, but=None):
        near = sorted((-round(sum(x * vectors[e].get(s, 0) for s, x in vectors[i].items()), 12), e) for e in examples if e != but)
        near = [(e, examples[e], -c) for c, e in near if c < 0][: toxicity.NEIGHBOURS]
        return near, (sum(y * c for _, y, c in near) + toxicity.PRIOR_VOTES * base) / (sum(c for _, _, c in near) + toxicity.PRIOR_VOTES)

    logit = lambda p: np.log(p / (1 - p))
    slope, intercept = toxicity.fit_platt(logit(np.array([voted(e, e)[1] for e in examples])), np.array(list(examples.values()), float))
    out = {}
    for i in texts:
        near, vote = voted(i)
        out[i] = near, float(1 / (1 + np.exp(-(slope * logit(vote) + intercept))))
    return out


_trained: dict = {}


def code_lengths(train: list[tuple[str, str]], langs: list[str], text: str, order: int = 4) -> list[float]:
    """Bits of the whole text in each language, byte by byte, after training on whole texts."""
    if _trained.get("on") is not train:
        counts = {lang: defaultdict(Counter) for lang in langs}
        _trained.update(on=train, counts=counts)
        for lang, t in train:
            raw = t.encode()
            for i in range(len(raw)):
                for k in range(min(order, i) + 1):
                    counts[lang][raw[i - k : i]][raw[i]] += 1
        for of in counts.values():
            for c in of.values():
                c["all"] = sum(c.values()) + len(c)
    raw, out = text.encode(), []
    for lang in langs:
        bits, counts = 0.0, _trained["counts"][lang]
        for i in range(len(raw)):
            for k in range(min(order, i), -1, -1):
                if not (c := counts.get(raw[i - k : i])):
                    continue
                if raw[i] in c:
                    bits -= math.log2(c[raw[i]] / c["all"])
                    break
                bits -= math.log2((len(c) - 1) / c["all"])
            else:
                bits += langid.FLAT_BITS
        out.append(bits)
    return out


def filled(sizes: list[int], weights: list[int]) -> list[float]:
    """Targets by repeated resharing."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > 3 * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
        left -= sum(target[i] for i in over)
        free -= over
    return target


def mixed(docs: list[tuple]) -> dict:
    """docs: id, text, source. The words that the mix takes of each, by one loop over a source's documents in order of their keys."""
    sizes = {i: len(words(t)) for i, t, _ in docs}
    sources = sorted({s for _, _, s in docs if s is not None}) + [None] * any(s is None for _, _, s in docs)
    whole = [sum(sizes[i] for i, _, s in docs if s == name) for name in sources]
    taken = {}
    for name, size, target in zip(sources, whole, filled(whole, [(5, 2, 1)[k % 3] for k in range(len(sources))]), strict=True):
        budget = math.floor(target + 0.5)
        epochs = budget // size if size else 0
        rest = budget - epochs * size
        for i in sorted((i for i, _, s in docs if s == name), key=lambda i: (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:15], 16), i)):
            part = max(0, min(sizes[i], rest))
            taken[i], rest = epochs * sizes[i] + part, rest - sizes[i]
    return taken

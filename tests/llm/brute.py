"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WS = " \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().split()


def exact(rows):
    """rows (doc_id, text) -> sorted (doc_id, keep_id, size, kept, sha)."""
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[hashlib.sha256(re.sub(f"[{WS}]+", " ", text or "").encode()).hexdigest()].append((doc, i))
    out = []
    for sha, members in groups.items():
        ids = [d for d, _ in members if d is not None]
        keep, done = min(ids) if ids else None, False
        for doc, _ in members:
            kept = doc == keep and not done
            done = done or kept
            out.append((doc, keep, len(members), kept, sha))
    return out


def shingles(text, k=5):
    w = [x.lower() for x in words(text)]
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def components(rows, k=5, percent=75):
    """rows (doc_id, text), ids distinct -> {doc_id: (n, component)}."""
    sets = {d: shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def targets(sizes, weights=(1, 2, 3), most=3):
    """sizes {source: words} -> {source: target}, excess shared anew until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= most * sizes[s]}
        if not over or len(over) == len(free):
            return {s: share.get(s, most * sizes[s]) for s in order}
        capped |= over


def bigram_scores(rows, held, discounts):
    """rows (doc_id, text) -> {doc_id: (n_tokens, n_known, N, base, score)}."""
    code = lambda t: [("B",)] + [(x.lower(),) for x in words(t)] + [("E",)]
    uni, pairs = Counter(), Counter()
    for d, t in rows:
        if not held(d):
            w = code(t)
            uni.update(w[1:])
            pairs.update(zip(w, w[1:], strict=False))
    n, v = sum(uni.values()), len(uni)
    times = Counter(min(c, 5) for c in pairs.values())
    d2 = discounts([times[k] for k in range(1, 5)])
    follows = Counter(w for _, w in pairs)
    few = Counter(min(c, 5) for c in follows.values())
    d1 = discounts([few[k] for k in range(1, 5)])
    spare = (d1[1] * few[1] + d1[2] * few[2] + d1[3] * sum(1 for c in follows.values() if c > 2)) / len(pairs) if pairs else 1.0
    total, left = Counter(), defaultdict(float)
    for (a, _), c in pairs.items():
        total[a] += c
        left[a] += d2[min(c, 3)]

    def single(w):
        c = follows.get(w, 0)
        return (c - d1[min(c, 3)]) / max(1, len(pairs)) + spare / (v + 1)

    out = {}
    for d, t in rows:
        w = code(t)
        score = base = 0.0
        for a, b in zip(w, w[1:], strict=False):
            c, q = pairs.get((a, b), 0), single(b)
            score += math.log10((max(c - d2[min(c, 3)], 0) + left[a] * q) / total[a] if total[a] else q)
            base += math.log10((uni.get(b, 0) + 1) / (n + v + 1))
        out[d] = (len(w) - 1, sum(1 for x in w[1:] if uni.get(x)), n, base, score)
    return out


def template_keys(line, leading=3, least=5, segments=4, least_open=16):
    t = ["<*>" if re.search(rb"\d", w) else w for w in line.encode().split()]
    n = len(t)
    if n < least or n - t.count("<*>") < least - 1:
        return set()
    keys = {(n, tuple(t))}
    if n >= least_open:
        m = n - leading
        cuts = [leading + m * k // segments for k in range(segments + 1)]
        keys |= {(n, k, tuple(t[: cuts[k]]), tuple(t[cuts[k + 1] :])) for k in range(segments)}
    return keys


def lines_left(rows):
    """rows (doc_id, text), ids distinct -> {doc_id: text without lines of templates that smaller ids have}."""
    first = {}
    for d, t in sorted(rows):
        for line in (t or "").split("\n"):
            for k in template_keys(line):
                first.setdefault(k, d)
    return {d: None if t is None else "\n".join(x for x in t.split("\n") if not any(first[k] != d for k in template_keys(x))) for d, t in rows}


def quality_base(text):
    w = words(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = [False] * len(w)
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    lines = [x for x in (text or "").split("\n") if x.strip(WS)]
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(hit)


def _char_class(c):
    if ord(c) >= 0x80:
        return "beyond"
    if c in WS:
        return "space"
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "lower" if c.islower() else "upper"
    if c in ".,;:!?":
        return "sentence"
    if c in "'\"()-":
        return "quote"
    return "symbol" if 0x20 < ord(c) < 0x7F else "control"


def _distance(p, q):
    total, out = sum(p.values()), 0.0
    for x in p.keys() | q.keys():
        a, b = p.get(x, 0) / total, q.get(x, 0)
        m = (a + b) / 2
        out += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(0, out / 2))


def quality_verdicts(rows, common=1 / 200, reference=2000):
    """rows (doc_id, text, lang) -> {doc_id: (kept, [distance of classes, of common words, of common against other words] or None)}."""
    chars, seen = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang in rows:
        chars[lang].update(map(_char_class, t or ""))
        seen[lang].update(w.lower() for w in words(t))
    total = {x: sum(c.values()) for x, c in seen.items()}
    langs = [x for x in seen if total[x] >= reference]
    classes = {x: {k: n / sum(chars[x].values()) for k, n in chars[x].items()} for x in langs}
    often = {x: {w: n / total[x] for w, n in seen[x].items() if n >= common * total[x]} for x in langs}
    every = {w for x in langs for w in often[x]}
    out = {}
    for d, t, lang in rows:
        w = [x.lower() for x in words(t)]
        n, n_chars, _, _, repeated = quality_base(t)
        kept = not (n < 20 or 100 * repeated > 30 * n)
        found = None
        if w and langs:
            mine = Counter(x if x in every else None for x in w)
            by_word = min(_distance(mine, {**often[x], None: max(0, 1 - sum(often[x].values()))}) for x in langs)
            share = 1.0
            for x in langs:
                own, mass = sum(mine.get(y, 0) for y in often[x]), sum(often[x].values())
                share = min(share, 0.0 if mass < 0.05 or own / len(w) >= mass else _distance(Counter({"common": own, "other": len(w) - own}), {"common": mass, "other": 1 - mass}))
            found = [min(_distance(Counter(map(_char_class, t)), classes[x]) for x in langs), by_word, share]
            if kept and lang in langs:
                kept = not (n_chars >= 200 and found[0] > 0.30 or n >= 60 and (by_word > 0.45 or share > 0.20))
        out[d] = (kept, found)
    return out


def whitened(rows, components=32):
    """rows (id, vector), vectors usable -> [(id, n, deviation, whitened by component)], eigenvalues, trace."""
    import numpy as np

    x = [[math.floor(64 * c) + 1000000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    # Integers are centred before they become doubles.
    centred = np.array([[float(n * a - s) for a, s in zip(row, sums, strict=True)] for row in x]) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, centred @ vectors / np.sqrt(values), values, (centred**2).sum() / n


def audit(rows, threshold, top=10):
    """rows (text, lang, source) -> {(lang, source, part, item, value, rank)}."""
    docs = [([x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")], a or "", b or "") for t, a, b in rows]
    out = set()
    for lang in {a for _, a, _ in docs}:
        held = Counter(w for t, a, _ in docs if a == lang for w in set(t))
        kept = sorted(w for w, n in held.items() if n >= threshold)
        count = {s: Counter() for _, a, s in docs if a == lang}
        for t, a, s in docs:
            if a == lang:
                count[s].update(w for w in t if held[w] >= threshold)
        p = {s: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept} for s, c in count.items()}
        whole = sum(count.values(), Counter())
        q = {w: 1 + 10**9 * (whole[w] + 2) // (sum(whole.values()) + 2 * len(kept)) for w in kept}
        apart = lambda x, y: (x - y) ** 2 // (x + y)
        for s in count:
            pairs = [(-sum(apart(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in count if o != s]
            terms = [(-apart(p[s][w], q[w]), w.encode(), w) for w in kept if count[s][w] and p[s][w] > q[w]]
            out |= {(lang, s, "pair", x, -v, i) for i, (v, _, x) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", x, -v, i) for i, (v, _, x) in enumerate(sorted(terms)[:top], 1)}
    return out

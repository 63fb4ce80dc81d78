"""Plain single-machine versions of what the operators compute."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPANS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def word_windows(docs, width):
    """{id: (words, removed, sha)}"""
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - width + 1):
            key = tuple(w[i:i + width])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] < d:
                gone.update(range(i, i + width))
        out[d] = len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def byte_strings(docs, width):
    """{id: (bytes, removed, runs, sha)}"""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        b, gone = (t or "").encode(), set()
        for i in range(len(b) - width + 1):
            key = b[i:i + width]
            if key in seen:
                gone.update(range(i, i + width))
            seen.add(key)
        out[d] = (len(b), len(gone), sum(i - 1 not in gone for i in gone), sha(bytes(x for i, x in enumerate(b) if i not in gone)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    out = []
    for k, (name, pattern) in enumerate(SPANS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if name == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if name == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if name == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end(), name))
    return sorted(out)


def components(docs, n, num, den):
    """{id: (set size, smallest linked id)}"""
    sets, lists, up = {}, defaultdict(list), {}
    for d, t in docs:
        w = words(lower(t))
        sets[d] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        up[d] = d

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for d in sorted(sets):
        shared = Counter()
        for g in sets[d]:
            shared.update(lists[g])
            lists[g].append(d)
        for o, k in shared.items():
            if den * k >= num * (len(sets[d]) + len(sets[o]) - k):
                a, b = find(d), find(o)
                up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def targets(sizes, weights=(1, 2, 3), most=3):
    """Water filling by rounds: {source: target}."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def kneser_ney(train, texts):
    """(train tokens, [(n_tokens, n_known, base, score)]) under an interpolated modified Kneser-Ney bigram model."""
    ends = lambda t: [*words(lower(t)), None]
    single, pairs = Counter(), Counter()
    for t in train:
        before = 0
        for w in ends(t):
            single[w] += 1
            pairs[before, w] += 1
            before = w
    wide, total, follow = Counter(w for _, w in pairs), Counter(), defaultdict(lambda: [0, 0, 0])
    for (u, _), c in pairs.items():
        total[u] += c
        follow[u][min(c, 3) - 1] += 1

    def discounts(values):
        n1, n2, n3, n4 = (sum(v == k for v in values) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        out = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        return [0.0, *(min(max(d, 0.05), k + 0.95) for k, d in enumerate(out))]

    dp, dw, n, v = discounts(pairs.values()), discounts(wide.values()), sum(single.values()), len(single)
    rest = sum(dw[min(c, 3)] for c in wide.values()) / len(pairs) if pairs else 1.0

    def lower_order(w):
        return ((wide[w] - dw[min(wide[w], 3)]) / len(pairs) if pairs else 0.0) + rest / (v + 1)

    out = []
    for t in texts:
        before, base, score, known = 0, 0.0, 0.0, 0
        for w in ends(t):
            c, p = pairs[before, w], lower_order(w)
            if total[before]:
                p = (c - dp[min(c, 3)]) / total[before] + sum(a * b for a, b in zip(dp[1:], follow[before])) / total[before] * p
            score += math.log10(p)
            base += math.log10((single[w] + 0.5) / (n + 0.5 * (v + 1)))
            known += single[w] > 0
            before = w
        out.append((len(ends(t)), known, base, score))
    return n, out

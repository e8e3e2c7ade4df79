"""Plain single-process versions of the operators, for small tables."""
import collections
import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall(t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def shingles(t, k=5, lower=True):
    w = words((t or "").translate(LOWER) if lower else t)
    if len(w) >= k:
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def jaccard_components(rows, percent=80):
    """[(doc_id, n_shingles, component_id)] of [(doc_id, text)] by comparing all pairs that share a shingle."""
    sets = [(d, shingles(t)) for d, t in rows]
    lists = collections.defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            lists[x].append(i)
    common = collections.Counter()
    for members in lists.values():
        for i in members:
            for j in members:
                if i < j:
                    common[i, j] += 1
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, j), c in common.items():
        if sets[i][0] is None or sets[j][0] is None:
            continue
        if 100 * c >= percent * (len(sets[i][1]) + len(sets[j][1]) - c):
            a, b = root(i), root(j)
            if a != b:
                up[a if sets[a][0] > sets[b][0] else b] = b if sets[a][0] > sets[b][0] else a
    return [(d, len(s), None if d is None else sets[root(i)][0]) for i, (d, s) in enumerate(sets)]


def jaccard_links(rows, percent=80):
    """[(doc_id, n_links)] of [(doc_id, text)] by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    ok = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    return [(d, sum(1 for j, (e, t) in enumerate(sets) if d is not None and e is not None and s and t and j != i and ok(s, t)))
            for i, (d, s) in enumerate(sets)]


def substring_dedup(rows, k=20):
    """[(doc_id, n_words, n_removed, kept_sha256)] in ascending (doc_id, text), nulls last."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode())):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            x = tuple(w[i:i + k])
            if x in seen:
                gone[i:i + k] = [True] * k
            seen.add(x)
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def statistics(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cover = [False] * len(w)
    for i in range(len(w) - 4):
        if seen[tuple(w[i:i + 5])] > 1:
            cover[i:i + 5] = [True] * 5
    n, rep = len(w), sum(cover)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep,
            n < 10 or 100 * rep > 20 * n)


def mcd_distances(rows, share, steps, floor, consistency, least):
    """Squared distance of each (lang, source, statistics) row to its finest estimate; None without one."""
    def vector(s):
        n, c, y, d, r = s[:5]
        return [np.log((c + 100) / (n + 20)), np.sqrt(y / (c + 100)), np.sqrt(d / (n / 10 + 10)), np.sqrt(r / (n + 20))]

    x = np.array([vector(s) for _, _, s in rows])
    good = np.array([not s[5] for _, _, s in rows], bool)
    fits = {}
    for key in {k for a, b, _ in rows for k in ((2, a, b), (1, a, None), (0, None, None))}:
        own = np.array([key in ((2, a, b), (1, a, None), (0, None, None)) for a, b, _ in rows], bool) & good
        v = x[own]
        if len(v) < least:
            continue
        low = lambda a, q: np.sort(a, axis=0)[max(0, int(np.ceil(q * len(a))) - 1)]
        mean = low(v, 0.5)
        cov = np.diag((1.4826 * low(np.abs(v - mean), 0.5)) ** 2)
        for _ in range(steps):
            inv = np.linalg.inv(cov + np.diag(np.square(floor)))
            d = np.einsum("ij,jk,ik->i", v - mean, inv, v - mean)
            near = v[d <= low(d, share)]
            mean, cov = near.mean(axis=0), consistency * np.cov(near.T, bias=True)
        fits[key] = (mean, np.linalg.inv(cov + np.diag(np.square(floor))))
    out = []
    for (a, b, _), v in zip(rows, x):
        fit = fits.get((2, a, b)) or fits.get((1, a, None)) or fits.get((0, None, None))
        out.append(float((v - fit[0]) @ fit[1] @ (v - fit[0])) if fit else None)
    return out


def base_spans(t):
    t = t or ""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def mix(rows, weights=(5, 2, 1), cap=3, seed=1):
    """[(size, source_size, target, copies)] of [(doc_id, text, source)]."""
    size = [len(words(t)) for _, t, _ in rows]
    total = collections.Counter()
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(total.values()) - sum(cap * total[s] for s in full)
        free = sum(w[s] for s in order if s not in full)
        target = {s: cap * total[s] if s in full else w[s] * left / free for s in order}
        over = {s for s in order if s not in full and target[s] > cap * total[s]}
        if not over:
            break
        full |= over
    out = []
    for (d, _, s), n in zip(rows, size):
        rate = target[s] / total[s] if total[s] else 0.0
        u = int(hashlib.md5(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16) / 2 ** 32
        out.append((n, total[s], target[s], int(rate) + (u < rate - int(rate))))
    return out


def counted_words(rows, least=5, count=3, every=97):
    """{word: n} of [(doc_id, text)]."""
    n = collections.Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(b) == len(a) + 1 and b[i + 1:] == a[i:]


def spelling(n):
    """[(word, form, root, n, n_near, form_n)] of {word: n}, by comparing all words that have a
    shortened spelling in common (short tables: all words)."""
    lists = collections.defaultdict(set)
    for w in n:
        for i in range(-1, len(w) if len(w) < 100 else -1):
            lists[w[:i] + w[i + 1:] if i >= 0 else w].add(w)
        if len(w) >= 100:
            lists[None].add(w)
    some = collections.defaultdict(set)
    for ws in lists.values():
        for w in ws:
            some[w] |= ws
    near = {w: [u for u in some[w] if one_edit(u, w)] for w in n}
    form = {}
    for w, us in near.items():
        best = min(us, key=lambda u: (-n[u], u), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return [(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n]


class KneserNey:
    """Interpolated modified Kneser-Ney in dictionaries; ``texts`` are lists of tokens."""

    def __init__(self, texts, order, fallback):
        self.order, self.counts, self.d = order, {}, {}
        top = collections.Counter()
        for t in texts:
            t = ["<s>"] * (order - 1) + t
            top.update(tuple(t[i - order + 1:i + 1]) for i in range(order - 1, len(t)))
        self.counts[order] = top
        for k in range(order - 1, 0, -1):
            self.counts[k] = collections.Counter(g[1:] for g in self.counts[k + 1])
        self.context = {k: collections.defaultdict(list) for k in self.counts}
        for k, c in self.counts.items():
            for g, n in c.items():
                self.context[k][g[:-1]].append(n)
            n = [sum(x == i for x in c.values()) for i in range(1, 5)]
            d = list(fallback)
            if min(n) > 0:
                y = n[0] / (n[0] + 2 * n[1])
                got = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
                if all(0 < x <= i for i, x in enumerate(got, 1)):
                    d = got
            self.d[k] = d
        self.words = {g[0] for g in self.counts[1]}
        self.share = {k: {c: (sum(of), sum(self.d[k][min(x, 3) - 1] for x in of)) for c, of in v.items()}
                      for k, v in self.context.items()}

    def p(self, gram):
        """Probability of the last of ``gram`` after the others."""
        if not gram:
            return 1 / (len(self.words) + 1)
        k = len(gram)
        below = self.p(gram[1:])
        if gram[:-1] not in self.share[k]:
            return below
        total, rest = self.share[k][gram[:-1]]
        d = self.d[k]
        n = self.counts[k].get(gram, 0)
        kept = max(n - d[min(n, 3) - 1], 0) if n else 0
        return (kept + rest * below) / total


def lm_scores(rows, order, fallback):
    """{doc_id: [(held_out, n_tokens, n_known, train_tokens, base_score, score)]} of [(doc_id, text)]."""
    texts = [words((t or "").translate(LOWER)) + ["</s>"] for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    train = [t for t, h in zip(texts, held) if not h]
    c = collections.Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    model = KneserNey(train, order, fallback)
    out = collections.defaultdict(list)
    for (d, _), t, h in zip(rows, texts, held):
        long = ["<s>"] * (order - 1) + t
        out[d].append((h, len(t), sum(w in c for w in t), n, sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t),
                       sum(np.log10(model.p(tuple(long[i:i + order]))) for i in range(len(t)))))
    return out

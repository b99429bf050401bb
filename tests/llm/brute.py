"""Plain versions of the corpus operators for small tables; nothing here is shared with the operators."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(f"[^{SPACE}]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def smallest(ids):
    return min(ids, key=lambda i: (i is not None, i or 0))


def line_dedup(rows, min_docs=3, min_chars=20):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(h := holders.get(key(x), ())) >= min_docs and i != max(h, key=lambda d: (d is not None, d or 0)) for x in lines]
        out.append((i, len(lines), sum(gone), sha("\n".join(x for x, g in zip(lines, gone) if not g))))
    return out


def quality(text, window=5):
    w = words(text)
    spots = defaultdict(list)
    for i in range(len(w) - window + 1):
        spots[tuple(w[i : i + window])].append(i)
    covered = {j for s in spots.values() if len(s) > 1 for i in s for j in range(i, i + window)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def quality_votes(text):
    """The ten rules' votes, from the text itself."""
    import unicodedata

    text = text or ""
    n, chars, symbols, dup_lines, repeats = quality(text)
    kinds = Counter(unicodedata.category(c) for c in text)
    letters, capitals = sum(v for k, v in kinds.items() if k[0] == "L"), kinds["Lu"]
    lines = [x for x in text.split("\n") if words(x)]
    per = lambda a, b: a / max(b, 1)
    stops, mean = per(text.count(".") + text.count("?"), n), per(chars, n)
    bad = [n < 10, per(symbols, n) > 0.1, per(text.count("|"), n) > 0.1, per(capitals, letters) > 0.3, per(text.count("!"), n) > 0.2, per(repeats, n) > 0.2, per(dup_lines, len(lines)) > 0.3, per(letters, chars) < 0.7]
    prose = [1 if 0.02 <= stops <= 0.4 else -1 if stops < 0.005 and n >= 50 else 0, 1 if 2.5 <= mean <= 12 else -1 if mean < 2 or mean > 15 else 0]
    return (*[-1 if b else 0 for b in bad], *prose)


def quality_fit(votes, steps=300, tolerance=1e-4):
    """EM over the votes of all documents; the posterior of good as a function of votes."""
    import math

    counts, rules = Counter(votes), len(votes[0])
    prior, good, bad = 0.8, [[0.02, 0.68, 0.3] for _ in range(rules)], [[0.3, 0.55, 0.15] for _ in range(rules)]

    def posterior(v):
        a, b = (x * math.prod(table[r][v[r] + 1] for r in range(rules)) for x, table in ((prior, good), (1 - prior, bad)))
        return a / (a + b)

    for _ in range(steps):
        p = {v: posterior(v) for v in counts}
        n, g = sum(counts.values()), sum(counts[v] * p[v] for v in counts)
        new = (g + 1) / (n + 2)
        to = lambda weight, whole: [[(sum(counts[v] * weight(v) for v in counts if v[r] == x) + 1) / (whole + 3) for x in (-1, 0, 1)] for r in range(rules)]
        tables = to(lambda v: p[v], g), to(lambda v: 1 - p[v], n - g)  # noqa: B023
        moved = max(abs(new - prior), *(abs(a - b) for old, now in zip((good, bad), tables) for x, y in zip(old, now) for a, b in zip(x, y)))
        prior, (good, bad) = new, tables
        if moved <= tolerance:
            break
    return posterior


def shingles(text, n):
    w = words((text or "").translate(LOWER))
    return set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(rows, n, percent=80):
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {i: (len(sets[i]), root(i)) for i in ids}


def substring_dedup(rows, size=13):
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = {j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(k, k + size)}
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def topk(vectors, queries, k=5):
    import math

    ok = {i: [math.floor(256 * x) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in queries:
        if q in ok:
            best = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Water filling, one round of resharing at a time. ``sizes``: source -> size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in held)
        open_ = [s for s in order if s not in held]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > cap * sizes[s]}
        if not above:
            return {s: cap * sizes[s] if s in held else share[s] for s in order}
        held |= above


def gram_ranks(counter: Counter, most):
    return {g: r for r, (g, _) in enumerate(sorted(counter.items(), key=lambda x: (-x[1], x[0]))[:most])}

"""Plain single-machine versions of the operators, for small inputs."""

import hashlib
import re

import numpy as np
import regex
import xxhash

SPACE = re.compile("[\x20\x09-\x0d]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def simhash(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def levenshtein(a, b):
    """Row by row; the least over deletions to the left is a running minimum."""
    x, y = (np.array([ord(c) for c in s], dtype=np.int64) for s in (a, b))
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for i in range(len(x)):
        best = np.concatenate([[i + 1], np.minimum(row[1:] + 1, row[:-1] + (y != x[i]))])
        row = np.minimum.accumulate(best - steps) + steps
    return int(row[-1])


def normal_lines(text):
    return [x.strip(" ") for x in regex.sub(r"[^\p{L}\p{N}\n]+", " ", (text or "").lower()).split("\n")]


def line_marks(line):
    """SimHashes of a line's words and word pairs, and its ends: words at its start and at its end, by their number."""
    w = line.split(" ")

    def marked(h):
        bits = (np.array(h, dtype=np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        return sum(1 << b for b in range(64) if 2 * int(bits[:, b].sum()) > len(h))

    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    # Spark's hash of two values seeds the second with that of the first
    pairs = [xxhash.xxh64_intdigest(b.encode(), a) for a, b in zip(h, w[1:])]
    sim = marked(h), marked(pairs)
    share = max(len(w) // 8, min(4, len(w) // 2))
    sizes = [share]
    if share > 4:
        step = 1
        while share >= 8 * step:
            step *= 2
        top = share // step * step
        sizes = [top, top - (max(1, step // 2) if top == 4 * step and step > 1 else step)]
    return sim, {(n, *w[:n]) for n in sizes}, {(n, *w[-n:]) for n in sizes}


def similar(a, b):
    longer = max(len(a), len(b))
    return min(len(a), len(b)) >= 0.8 * longer and levenshtein(a, b) <= 0.2 * longer + 1e-9


def line_links(lines):
    marks = [line_marks(x) for x in lines]
    out = []
    for i in range(len(lines)):
        for j in range(i + 1, len(lines)):
            if line_near(marks[i], marks[j]) and similar(lines[i], lines[j]):
                out.append((i, j))
    return out


def line_near(a, b):
    words, pairs = ((x ^ y).bit_count() for x, y in zip(a[0], b[0]))
    return words <= 3 or bool(words <= 10 and pairs <= 10 and (a[1] & b[1] or a[2] & b[2]))


def line_dedup(docs, links=line_links):
    """docs: (id, text) in order of id. The cleaned texts."""
    seen = {}
    for i, text in docs:
        for p, line in enumerate(normal_lines(text)):
            if len(line.split(" ")) >= 5:
                seen.setdefault(line, []).append((i, p))
    lines = sorted(seen)
    groups = {}
    for line, c in zip(lines, classes(len(lines), links(lines))):
        groups.setdefault(c, []).extend(seen[line])
    drop = {x for g in groups.values() for x in g if x != min(g)}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in drop) for i, t in docs}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m[0])) <= 15),
}
SECRETS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
}


def base_spans(text, kinds):
    found = [(m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text or "", re.A) if ok(m)]
    listed = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
    return listed, {k: sum(f[2] == k for f in found) for k in kinds}


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeat_words(w):
    from collections import Counter

    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    return len({j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)})


def cosine_links(vectors, threshold=0.98):
    """vectors: (id, list or None, label). Links by position."""
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in vectors]
    pairs = []
    for i in range(len(vectors)):
        for j in range(i + 1, len(vectors)):
            if ok[i] and ok[j] and vectors[i][2] == vectors[j][2] and len(vectors[i][1]) == len(vectors[j][1]):
                a, b = np.array(vectors[i][1], dtype=np.float64), np.array(vectors[j][1], dtype=np.float64)
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                    pairs.append((i, j))
    return pairs

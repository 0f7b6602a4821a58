"""Plain versions of the operators, row by row."""

import random
import re

import xxhash

WORDS = "the of and to a in that is was it river stone paper window garden letter summer morning market engine".split()
BLANK = re.compile("[ \t\n\x0b\f\r]+")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.4 else "") for _ in range(n))


def tokens(text):
    return [w for w in BLANK.split(text or "") if w]


def simhash(text, k=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = tokens(lowered)
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=4):
    """Least id reachable of each (id, fingerprint)."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(prints):
        least[root(i)] = min(key, least.get(root(i), key))
    return {key: least[root(i)] for i, (key, _) in enumerate(prints)}


def spans(text, rules):
    """(start, rank, end, kind) of the matches that a rule's check lets pass; rules: (kind, pattern, check)."""
    out = []
    for rank, (kind, pattern, check) in enumerate(rules):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if check(m)]
    return sorted(out)


def listed(found):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in found)


SECRETS = [
    ("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
]


def luhn(number):
    values = [int(d) for d in reversed(number)]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(values)) % 10 == 0


def only_digits(text):
    return re.sub("[^0-9]", "", text)


PRIVATE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(only_digits(m[0])) <= 19 and luhn(only_digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only_digits(m[0])) <= 15),
]


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    text = text or ""
    ws = tokens(text)
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    often = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else _often(windows)
    covered = {i + j for i, w in enumerate(windows) if w in often for j in range(3)}
    lines = [line for line in text.split("\n") if tokens(line)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def _often(windows):
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    return twice


def squeezed(text):
    return BLANK.sub("", text or "")


def exact(rows):
    """{row number: (keep_id, group_size, kept)} of (id, text) rows."""
    groups = {}
    for k, (_, text) in enumerate(rows):
        groups.setdefault(squeezed(text), []).append(k)
    out = {}
    for ks in groups.values():
        first = min(ks, key=lambda k: (-len(rows[k][1] or ""), rows[k][0] is None, rows[k][0] or 0, k))
        out |= {k: (rows[first][0], len(ks), k == first) for k in ks}
    return out


def targets(sizes):
    """Target of each source of {source: tokens}."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = [s for s in names if s not in full]
        share = total - 3 * sum(sizes[s] for s in full)
        out = {s: 3.0 * sizes[s] for s in full} | {s: share * weight[s] / sum(weight[x] for x in left) for s in left}
        above = {s for s in left if out[s] > 3 * sizes[s]}
        if not above:
            return out
        full |= above

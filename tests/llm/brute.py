"""Plain Python versions of the corpus operators, for small inputs."""

import hashlib
import re

SPACES = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(SPACES, text or "")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def dedup(rows, window=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(first.get(s, i), i, key=lambda x: (x is None, x if x is not None else 0))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            f = first[tuple(w[k : k + window])]
            if f is not None and (i is None or f < i):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return out


def shingles(text, size=5):
    w = words(ascii_lower(text))
    if not w:
        return set()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))}


def components(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        out.append((i, len(sets[a]), min(ids, default=None) if sets[a] else i))
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def contamination(rows, items, window=13):
    wanted = {}
    for i, t in items:
        w = bench_words(t)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            wanted.setdefault(tuple(w[k : k + size]), set()).add(i)
    sizes = {len(s) for s in wanted}
    out = []
    for i, t in rows:
        w, hit, found = bench_words(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                s = tuple(w[k : k + size])
                if s in wanted:
                    hit |= set(range(k, k + size))
                    found |= wanted[s]
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for n, kind, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 20), (2, "hex", r"[0-9a-f]+", 24)):
        out += [(m.start(), n, kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)

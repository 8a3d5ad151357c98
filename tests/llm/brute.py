"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return (text or "").translate(LOWER)


def base_quality(text):
    text = text or ""
    words, lines = SPACE.findall(text), [x for x in text.split("\n") if SPACE.search(x)]
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    repeated = {i + j for at in places.values() if len(at) > 1 for i in at for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def shingles(text, k=4):
    words = SPACE.findall(low(text))
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def components(docs, num=85, den=100):
    """doc_id -> (set size, component)."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    met = defaultdict(list)
    for d in sorted(sets):
        counts = Counter(e for g in sets[d] for e in met[g])
        for g in sets[d]:
            met[g].append(d)
        for e, n in counts.items():
            if den * n >= num * (len(sets[d]) + len(sets[e]) - n):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def contamination(text, items, window=10):
    """(words, hit places, items)."""
    words = ALNUM.findall(low(text))
    hit, found = set(), set()
    for item_id, item in items:
        parts = ALNUM.findall(low(item))
        n = min(window, len(parts))
        for s in range(len(parts) - n + 1) if n else ():
            gram = parts[s : s + n]
            for i in range(len(words) - n + 1):
                if words[i : i + n] == gram:
                    hit.update(range(i, i + n))
                    found.add(item_id)
    return len(words), hit, found


ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def secrets(text):
    """(start, kind number, end), sorted."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def spans_text(spans, kinds=("assign", "access", "hex")):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()

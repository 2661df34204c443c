"""Brute-force versions the tests compare with."""
import re

import regex
import xxhash


def brute_fingerprint(text):
    words = [w for w in regex.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(values, radius=4):
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    values = list(parent)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {v: top(v) for v in values}


def brute_matches(docs, items, window):
    split = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    low = lambda t: split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for doc, text in docs:
        words, hit, found = low(text), set(), set()
        for item, other in items:
            w = low(other)
            for at in range(max(min(1, len(w)), len(w) - window + 1)):
                part = w[at:at + window]
                for i in range(len(words) - len(part) + 1):
                    if words[i:i + len(part)] == part:
                        hit.update(range(i, i + len(part)))
                        found |= {item} - {None}
        out.append((doc, len(words), len(hit), sorted(found)))
    return out


def brute_longest(text, other, window):
    """(place in the item, first word, words) of every match that neither text lets grow, of a window or all of a shorter item."""
    split = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    low = lambda t: split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    a, b = low(text), low(other)
    out = []
    for i in range(len(a)):
        for j in range(len(b)):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n and n >= min(window, len(b)):
                out.append((j, i, n))
    return out


def brute_secrets(text):
    t, out = text or "", []
    for k, (pattern, group, least) in enumerate([(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24)]):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, t, re.ASCII) if len(m[group]) >= least]
    return sorted(out)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """The smallest id of each component; similarity 0.8 or more of five-word shingles links, null ids come last."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        place = doc is None, doc or 0
        least[find(i)] = min(least.get(find(i), place), place)
    return [None if missing else doc for missing, doc in sorted(least.values())]

"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def repeat_words(w, k=8):
    at = {}
    for i in range(len(w) - k + 1):
        at.setdefault(tuple(w[i:i + k]), []).append(i)
    return len({i + j for places in at.values() if len(places) > 1 for i in places for j in range(k)})


def measures(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeat_words(w), "n_upper": sum("A" <= c <= "Z" for c in text or ""),
            "n_bangs": (text or "").count("!")}


def kept_v1(text):
    m = measures(text)
    n = m["n_words"]
    return not (n < 20 or 100 * m["n_repeat_words"] > 30 * n or 10 * m["n_symbols"] > 3 * n or not 2 * n <= m["word_chars"] <= 15 * n
                or (m["n_lines"] >= 4 and 10 * m["n_dup_lines"] > 5 * m["n_lines"]) or 2 * m["n_upper"] > m["word_chars"] or 10 * m["n_bangs"] > 3 * n)


def shingles(text, k=3):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def reach(ids, links):
    """id -> smallest id it reaches."""
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def near(docs, percent=85):
    """id -> (set size, component) for {id: text}."""
    sets = {i: shingles(t) for i, t in docs.items()}
    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    pairs = {p for members in where.values() for p in combinations(sorted(members), 2)}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    top = reach(docs, links)
    return {i: (len(s), top[i]) for i, s in sets.items()}


def substrings(docs, k=20):
    """id -> (words, words kept) for {id: text}, in id order."""
    seen, out = set(), {}
    for i in sorted(docs):
        w, gone = words(docs[i]), set()
        for s in range(len(w) - k + 1):
            key = tuple(w[s:s + k])
            if key in seen:
                gone.update(range(s, s + k))
            seen.add(key)
        out[i] = (w, [x for j, x in enumerate(w) if j not in gone])
    return out


def padding(lengths, edges):
    edges = sorted(edges)
    return sum(next(e for e in edges if e >= n) - n for n in lengths)


def least_padding(lengths, buckets):
    kinds = sorted(set(lengths))
    return min(padding(lengths, [*some, kinds[-1]]) for r in range(min(buckets, len(kinds))) for some in combinations(kinds[:-1], r))

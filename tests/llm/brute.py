"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return [w for w in re.split("[\x20\x09-\x0d]+", lower(text or "")) if w]


def shingles(text: str | None, width: int) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def secrets(text: str | None) -> dict:
    text = text or ""
    found = []
    either = r"(?i:(password|passwd|secret|token|api_?key))"
    for place, (kind, pattern, group, least) in enumerate(
        (
            ("assign", either + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20),
            ("hex", r"[0-9a-f]+", 0, 24),
        )
    ):
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m[group]) >= least:
                found.append((m.start(), place, m.end(), kind))
    found.sort()
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
    count = lambda k: sum(f[3] == k for f in found)
    return {
        "n_assign": count("assign"),
        "n_access": count("access"),
        "n_hex": count("hex"),
        "base_sha256": hashlib.sha256(joined.encode()).hexdigest(),
        "base": joined,
    }


def near_duplicates(docs: dict[int, str | None], width: int = 4, percent: int = 80) -> dict[int, int]:
    """The component of every doc_id, from all pairs that share a shingle."""
    sets = {i: shingles(t, width) for i, t in docs.items()}
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    shared: dict[tuple[int, int], int] = defaultdict(int)
    for ids in at.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                shared[a, b] += 1
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in docs}


def licenses(text: str | None) -> dict:
    w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or "")) if x]
    found = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    at = [k for k, _ in found]
    return {
        "n_words": len(w),
        "n_base": len(at),
        "first_word": min(at, default=None),
        "last_word": max(at, default=None),
        "base_labels": ",".join(sorted({x for _, x in found})),
    }

"""Plain-Python statements of what the operators must return, straight from their contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def quality_base(text):
    text = text or ""
    words = SPACED.findall(text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i:i + 5])] > 1:
            covered.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def _kinds(spans, kinds):
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))


def told(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secret_base(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text,
                         re.I | re.A):
        if len(m[2]) >= 6:
            found.append(("assign", *m.span()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append(("access", *m.span()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append(("hex", *m.span()))
    return _kinds(found, ["assign", "access", "hex"])


def personal_base(text):
    text = text or ""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = 0
        for i, d in enumerate(reversed(digits)):
            d = 2 * d if i % 2 else d
            total += d - 9 if d > 9 else d
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return _kinds(found, ["email", "ip", "card", "phone"])


def contamination(texts, items):
    """{position: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    windows: dict[tuple, set] = {}
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        size = min(13, len(words))
        if size:
            for i in range(len(words) - size + 1):
                windows.setdefault(tuple(words[i:i + size]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for text in texts:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                got = windows.get(tuple(words[i:i + size]))
                if got:
                    found |= got
                    hit.update(range(i, i + size))
        out.append((len(words), len(hit), len(found), sha(",".join(sorted(found))),
                    len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def shingles(text):
    words = SPACED.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def components(ids, texts):
    """Set sizes, and smallest linked id per row, by comparing all sets that share a shingle."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j > i)
        for j, both in shared.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                parent[root(j)] = root(i)
    least: dict[int, int] = {}
    for i in range(len(sets)):
        r = root(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return [(ids[i], len(sets[i]), least[root(i)]) for i in range(len(sets))]

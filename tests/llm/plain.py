"""Plain versions of the operators, one document or pair at a time."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

LARGEST = (1 << 63) - 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key_of(i):
    return LARGEST if i is None else i


def quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(grams)
    covered = {p for k, g in enumerate(grams) if n[g] > 1 for p in range(k, k + 3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def fingerprint(text):
    w = words(text, lower=True)
    grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(rows, radius=4):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    least = defaultdict(lambda: LARGEST)
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], key_of(i))
    known = lambda x: None if x == LARGEST else x
    return [(i, f"{p:016x}", known(least[find(k)])) for k, ((i, _), p) in enumerate(zip(rows, prints, strict=True))]


def substrings(rows, n=13):
    first = {}
    split = [(key_of(i), words(t)) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            first[g] = min(first.get(g, LARGEST), i)
    out = []
    for (i, _), (k_of, w) in zip(rows, split, strict=True):
        gone = {p for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < k_of for p in range(k, k + n)}
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def lines(rows):
    first, holders = {}, defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = line_key(x)
            first[k] = min(first.get(k, LARGEST), key_of(i))
            holders[k].add(key_of(i))
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        keep = [len(line_key(x)) < 10 or first[line_key(x)] == key_of(i) for x in all_lines]
        kept = "\n".join(x for x, k in zip(all_lines, keep, strict=True) if k)
        out.append((i, len(all_lines), len(all_lines) - sum(keep), kept, keep))
    return out


def shingles(text):
    w = words(text, lower=True)
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])


def contaminated(text, items, least=0.8):
    """Ids of items to which a window of as many shingles comes near enough."""
    own, found = shingles(text), set()
    for item, passage in items:
        wanted = Counter(shingles(passage))
        size = sum(wanted.values())
        for k in range(-size + 1, len(own) if size else 0):
            window = Counter(own[max(k, 0) : k + size])
            if window and sum((window & wanted).values()) / sum((window | wanted).values()) >= least:
                found.add(item)
                break
    return found

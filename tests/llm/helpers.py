"""Brute-force versions of the operators, in plain Python."""

import hashlib
import re
from collections import Counter
from itertools import combinations

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Nulls, empty and blank texts, ties, repeated rows, one long text, unusual white space.
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix a strange potion in the old tower".split()


def words(text, pattern=BLANK):
    return pattern.findall(text or "")


def edge_texts():
    long = " ".join(f"{PROSE[i % len(PROSE)]}{i % 977}" for i in range(30_000))
    passage = " ".join(f"shared{i}" for i in range(60))
    return [
        (1, " ".join(PROSE) + " " + passage),
        (2, passage + " tail words here"),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, "one"),
        (7, "two words"),
        (8, "two words"),
        (9, long),
        (10, long + " more"),
        (11, "Übergröße naïve ÉCOLE " + passage.upper()),
        (11, "Übergröße naïve ÉCOLE " + passage.upper()),
        (None, passage),
        (12, "\u00a0nbsp\u00a0 " + " ".join(PROSE)),
    ]


def contaminated(docs, items, size=10):
    windows = {}
    for item, text in items:
        own = words((text or "").translate(LOWER), ALNUM)
        k = min(size, len(own))
        for i in range(len(own) - k + 1 if k else 0):
            windows.setdefault(tuple(own[i : i + k]), set()).add(item)
    out = []
    for doc, text in docs:
        own, hit, found = words((text or "").translate(LOWER), ALNUM), set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(own) - k + 1):
                if tuple(own[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(own[i : i + k])]
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(own), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def deduplicated(docs, k=13):
    first = {}
    for doc, text in docs:
        own = words(text)
        for i in range(len(own) - k + 1):
            w = tuple(own[i : i + k])
            if doc is not None:
                first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in docs:
        own, gone = words(text), set()
        for i in range(len(own) - k + 1):
            if doc is not None and first[tuple(own[i : i + k])] < doc:
                gone.update(range(i, i + k))
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out.append((doc, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def jaccard(docs, size=5, threshold=0.8):
    """{row number: (class, links)}"""
    sets, by_shingle, shared = [], {}, Counter()
    for n, (doc, text) in enumerate(docs):
        own = words(text)
        sets.append({tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own and doc is not None else set())
        for s in sets[n]:
            by_shingle.setdefault(s, []).append(n)
    for rows in by_shingle.values():
        shared.update(combinations(rows, 2))
    parent, links = list(range(len(docs))), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    least = {}
    for n, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(n)] = min(least.get(root(n), doc), doc)
    return [(doc, least[root(n)] if doc is not None else None, links[n]) for n, (doc, _) in enumerate(docs)]


def base_rules(text):
    text = text or ""
    own = words(text)
    rows = [line for line in text.split("\n") if BLANK.search(line)]
    windows = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 5))
    failed = len(own) < 10 or 100 * len(covered) > 20 * len(own)
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(rows) - len(set(rows)), len(covered), failed

"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

SPACES = " \t\n\x0b\x0c\r"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def line_dedup(rows, min_chars=40, min_docs=5):
    def key(line):
        return line.strip(SPACES).translate(AZ)

    held = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(d)
    low = float("-inf")
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(h := held[key(x)]) >= min_docs and d != max(h, key=lambda i: low if i is None else i))]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def leaks(rows, items, n=13):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))

    windows = []
    for i, text in items:
        w = words(text)
        k = min(n, len(w))
        windows += [(str(i), tuple(w[j : j + k])) for j in range(len(w) - k + 1) if k]
    by = defaultdict(set)
    for i, w in windows:
        by[w].add(i)
    sizes = {len(w) for w in by}
    out = []
    for d, text in rows:
        w = words(text)
        hit, found = set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if own := by.get(tuple(w[j : j + k])):
                    hit.update(range(j, j + k))
                    found |= own
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def near_copies(rows, k=2, share=0.8):
    sets = {}
    for d, text in rows:
        w = [x.translate(AZ) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets[d] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= round(100 * share) * len(sets[a] | sets[b])]
    root = components(ids, links)
    return [(d, len(sets[d]), root[d], root[d] == d) for d in ids]

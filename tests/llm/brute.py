"""Plain Python versions of the contracts, for small inputs."""

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contamination(docs, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    wanted = {}
    for item, text in items:
        w = split(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            wanted.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    lengths = {len(k) for k in wanted}
    out = {}
    for doc, text in docs:
        w = split(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (got := wanted.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= got
        out[doc] = {"doc_id": doc, "n_words": len(w), "n_hit": len(hit), "n_items": len(found), "items_sha256": hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), "contaminated": bool(hit) and 20 * len(hit) >= len(w)}
    return out


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_links(docs, k=4, threshold=85):
    sets = {d: shingles(t, k) for d, t in docs}
    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    links = set()
    for a, s in sets.items():
        common = {}
        for x in s:
            for b in where[x]:
                if b > a:
                    common[b] = common.get(b, 0) + 1
        for b, i in common.items():
            if 100 * i >= threshold * (len(s) + len(sets[b]) - i):
                links.add((a, b))
    return sets, links

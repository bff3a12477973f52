"""Brute-force forms that several tests share."""

import collections

from tagtriage.llm import probminhash


def brute_lines(docs, least=20, n_docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    held = collections.defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            held[key(x)].add((i, t))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = []
        for x in lines:
            ids = [d for d, _ in held[key(x)] if d is not None]
            gone = len(key(x)) >= least and len(held[key(x)]) >= n_docs and ids and (i is None or i < max(ids))
            if not gone:
                stay.append(x)
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def brute_classes(docs):
    cache = {}
    sh = {i: probminhash.shingles(t, cache) for i, t in docs}
    root = {i: i for i in sh}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sh)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if len(sh[i][0]) and len(sh[j][0]) and probminhash.probability_jaccard(*sh[i], *sh[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}

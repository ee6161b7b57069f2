"""Plain versions of what the operators compute."""

import re


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, live, out = sum(sizes.values()), set(sizes), {}
    while live:
        share = {s: left * weight[s] / sum(weight[x] for x in live) for s in live}
        over = {s for s in live if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        live -= over
    return out


def brute_components(items):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in items]
    up = list(range(len(items)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 75 * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(items):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(map(str, ((items[k][0], len(sets[k]), least.get(top(k))) for k in range(len(items)))))

"""Plain versions of the operators, one document at a time."""

import math
import re
from collections import Counter

WORD = re.compile("[0-9a-z_\u0080-\U0010ffff]+")
MASK = (1 << 64) - 1


def words(text):
    return WORD.findall((text or "").lower())


def multiset(text, k=2):
    w = words(text)
    k = min(k, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else Counter()


def weighted_jaccard(a, b):
    inter = sum((a & b).values())
    return inter / max(1, sum(a.values()) + sum(b.values()) - inter)


def near_groups(rows, threshold=0.6):
    """{index: least index of its group} over (doc_id, text), single rows left out; index order is
    that of ids, nulls last."""
    sets = [multiset(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and weighted_jaccard(sets[i], sets[j]) >= threshold:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    out = {i: find(i) for i in range(len(rows)) if sets[i]}
    size = Counter(out.values())
    return {i: g for i, g in out.items() if size[g] > 1}


def containment(item, text, k=5):
    w, x = words(item), words(text)
    k = min(k, len(w))
    if not k:
        return 0.0
    own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return len(own & {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}) / len(own)


def tokens(text):
    return len(re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+|[!-/:-@\[-^`{-\x7f]", text or ""))


def fmix(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & MASK
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & MASK
    return x ^ x >> 33


GOLD = 0x9E3779B97F4A7C15


def landmarks(names):
    x = list(names)
    for _ in range(4):
        new = []
        for i, v in enumerate(x):
            d = (v ^ x[i - 1]) if i else 0
            low = (d & -d).bit_length() - 1 if i else 0
            new.append(2 * low + (v >> low & 1))
        x = new
    for v in (3, 4, 5):
        was = list(x)
        for i in range(len(x)):
            if was[i] == v:
                near = {was[j] for j in (i - 1, i + 1) if 0 <= j < len(x)}
                x[i] = min({0, 1, 2} - near)
    get = lambda i, d: x[i] if 0 <= i < len(x) else d
    top = [x[i] > get(i - 1, -1) and x[i] > get(i + 1, -1) for i in range(len(x))]
    low = [x[i] < get(i - 1, 9) and x[i] < get(i + 1, 9) for i in range(len(x))]
    return [i for i in range(len(x)) if i == 0 or top[i] or (low[i] and not (top[i - 1] or (i + 1 < len(x) and top[i + 1])))]


def lcp(names, level):
    """(levels, root, phrases of the level)."""
    depth, kept = 0, None
    while True:
        if depth == level:
            kept = list(names)
        if len(names) == 1:
            return depth, names[0], kept if kept is not None else list(names)
        runs = []
        for v in names:
            if runs and runs[-1][0] == v:
                runs[-1][1] += 1
            else:
                runs.append([v, 1])
        names = [fmix((v * GOLD + n) & MASK) if n > 1 else v for v, n in runs]
        at = landmarks(names) + [len(names)]
        out = []
        for a, b in zip(at[:-1], at[1:]):
            h = fmix((names[a] + 0x1234567) & MASK)
            for v in names[a + 1 : b]:
                h = fmix((h * GOLD + v) & MASK)
            out.append(h)
        names = out
        depth += 1


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_quality(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    hit = {i + k for i in range(len(ws) - 4) if grams[tuple(ws[i : i + 5])] > 1 for k in range(5)}
    failed = len(ws) < 10 or 100 * len(hit) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def contamination(docs, items, width=10):
    wins = {}
    for item, text in items:
        ws = ITEM_WORD.findall((text or "").translate(UPPER))
        n = min(width, len(ws))
        for i in range(len(ws) - n + 1 if ws else 0):
            wins.setdefault(tuple(ws[i : i + n]), set()).add(item)
    lengths = {len(w) for w in wins}
    out = []
    for doc, text in docs:
        ws = ITEM_WORD.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(ws) - n + 1):
                if (w := tuple(ws[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in wins[w] if x is not None}
        out.append((doc, len(ws), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    found.sort()
    count = Counter(k for *_, k in found)
    return count["assign"], count["access"], count["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in found))


def shingles(text, width):
    ws = WORD.findall((text or "").translate(UPPER))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1)))


def jaccard_components(docs, width, percent):
    sets = [(d, shingles(t, width)) for d, t in docs]
    reps = {}
    for d, s in sets:
        if s:
            reps.setdefault(s, []).append(d)
    keys = list(reps)
    up = list(range(len(keys)))
    links = {a: len(own) - 1 for a, own in reps.items()}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(keys):
        for j in range(i):
            b = keys[j]
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= percent * (len(a) + len(b) - n):
                    up[top(i)] = top(j)
                    links[a] += len(reps[b])
                    links[b] += len(reps[a])
    least = {}
    for i, a in enumerate(keys):
        ids = [d for d in reps[a] if d is not None]
        least[top(i)] = min([*ids, *([least[top(i)]] if least.get(top(i)) is not None else [])], default=None)
    where = {a: top(i) for i, a in enumerate(keys)}
    return [(d, len(s), least[where[s]] if s else d, links.get(s, 0)) for d, s in sets]

"""What the operators have to return, by plain definitions over small lists."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(_LOWER)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_sets(docs, n):
    out = []
    for _, text in docs:
        w = SPACED.findall(lower(text))
        m = min(n, len(w))
        out.append({tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set())
    return out


def near_duplicates(docs, n, percent):
    """Rows (doc_id, n_shingles, component_id, kept); ids are distinct and not null."""
    sets, root = shingle_sets(docs, n), {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(docs):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                x, y = find(a), find(docs[j][0])
                root[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d), find(d) == d) for (d, _), s in zip(docs, sets, strict=True))


def decontamination(docs, items, n):
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = ALNUM.findall(lower(text))
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    out = []
    for d, text in docs:
        w, hit, found = ALNUM.findall(lower(text)), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if (owners := windows.get(tuple(w[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    found |= owners
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def substring(docs, n):
    """Rows (doc_id, n_words, n_removed, kept_sha256); a null id is larger than any other."""
    key = lambda d: (d is None, d or 0)
    least: dict[tuple, tuple] = {}
    split = [SPACED.findall(t or "") for _, t in docs]
    for (d, _), w in zip(docs, split, strict=True):
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            least[k] = min(least.get(k, key(d)), key(d))
    out = []
    for (d, _), w in zip(docs, split, strict=True):
        gone = set()
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < key(d):
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def base_score(docs, held):
    """doc_id -> (n_tokens, n_known, train_tokens, base_score) for documents with an id."""
    split = [[*SPACED.findall(lower(t)), None] for _, t in docs]
    counts = Counter(x for (d, _), w in zip(docs, split, strict=True) if not held(d) for x in w)
    total, kinds = sum(counts.values()), len(counts)
    return {d: (len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w)) for (d, _), w in zip(docs, split, strict=True)}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


_PII = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
)


def personal(text):
    """Spans (kind, start, end) of the base patterns."""
    return [(kind, *m.span()) for kind, pattern, good in _PII for m in pattern.finditer(text or "") if good(m[0])]


def nearest(vectors, queries, k):
    """query_id -> [(vec_id, score)] over (vec_id, vector) of usable vectors."""
    good = [(i, v) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if queries(i):
            scored = [(j, math.fsum(a * b for a, b in zip(v, u, strict=True))) for j, u in good if j != i]
            out[i] = sorted(scored, key=lambda x: (-x[1], x[0]))[:k]
    return out

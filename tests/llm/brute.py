"""Plain Python versions of the operators, for small tables."""

import re
from itertools import combinations

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contamination(texts, items, window=10):
    """(n_words, hit word places, item ids) for each text."""
    wanted = {}
    for item, text in items:
        w = words(text)
        if item is None or not w:
            continue
        k = min(window, len(w))
        for i in range(len(w) - k + 1):
            wanted.setdefault(tuple(w[i:i + k]), set()).add(str(item))
    sizes = {len(k) for k in wanted}
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                names = wanted.get(tuple(w[i:i + k]))
                if names:
                    found |= names
                    hit |= set(range(i, i + k))
        out.append((len(w), hit, found))
    return out


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def groups(texts, percent=75):
    """Group number of each text: the first place of its component."""
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                r, s = find(a), find(b)
                parent[max(r, s)] = min(r, s)
    return [find(i) for i in range(len(sets))]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def personal(text):
    """Base spans (start, kind number, end)."""
    out = []
    for number, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits)
                    or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((m.start(), number, m.end()))
    return sorted(out)

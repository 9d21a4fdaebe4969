"""Plain Python versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import defaultdict

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def lines(rows, min_docs=5, min_chars=40):
    """rows (id, text) -> [(id, lines, dropped, text that stays)]."""
    key = lambda x: x.strip(SPACE).translate(UPPER)
    held = defaultdict(list)
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k].append(doc)
    last = {k: max((x for x in v if x is not None), default=None) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if last.get(key(x), doc) in (doc, None)]
        out.append((doc, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def substrings(rows, width=20):
    seen, out = set(), []
    for doc, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if window in seen:
                gone.update(range(i, i + width))
            seen.add(window)
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def shingles(text, width=5):
    words = WORD.findall((text or "").translate(UPPER))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def smallest_reachable(ids, links):
    at = {i: i for i in ids}

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        at[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near(rows, percent=85):
    """rows (id, text) with distinct ids -> {id: (set size, component)}."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    component = smallest_reachable(ids, links)
    return {i: (len(sets[i]), component[i]) for i in ids}


def mix(rows, weights=(5.0, 2.0, 1.0), total=1.5, most=2.0, seed=17):
    """rows (id, source, size) -> [(id, size, source size, target, copies)]; targets by filling again and again."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n in rows if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    left, target, open_ = total * sum(size.values()), {}, set(sources)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * size[s]}
        for s in full or open_:
            target[s] = most * size[s] if full else share[s]
            left -= target[s]
        open_ -= full or open_
    out = []
    for s in sources:
        rate = target[s] / size[s] if size[s] else 0.0
        name = f"{s or ''}{'/null/' if s is None else '/'}{seed}"
        offset = int(hashlib.md5(name.encode()).hexdigest()[:8], 16) / 2**32
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0] is None, r[0] or 0))
        for i, (doc, _, n) in enumerate(own):
            out.append((doc, n, size[s], target[s], math.floor((i + 1) * rate + offset) - math.floor(i * rate + offset)))
    return out


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def personal(text):
    """The base spans as the contract's patterns find them."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [f"{kind}:{m.start()}:{m.end()}" for kind, pattern, good in rules for m in re.finditer(pattern, text) if good(m)]

"""PII: high-recall generators propose spans, boosted trees judge them, calibrated thresholds select.

Base spans (plain e-mail addresses, IPv4 addresses, card numbers that pass their checksum, international phone
numbers) are found by pattern and always stay. Generators with wider patterns propose more, overlapping ones:
obfuscated addresses, IPv6 and masked IPv4, digit groups like cards or national phone numbers. Trees score a
proposal by its form and its surroundings; they are trained here, on examples drawn by rule from a seed, of spans
and of look-alikes (dates, versions, hashes, prices, counters). For each kind, the threshold is the least
calibrated score at which the examples kept for calibration are 95 % right. Spans are code points, end exclusive.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.boost import Boosted, Isotonic
from lexigrove.llm.common import documents, map_rows

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain.tld from left to right, found from each @, so that no text takes quadratic time."""
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            yield lo, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    found["email"] = list(base_emails(text))
    for m in _IP.finditer(text):
        # the first number is a whole run of digits: what a run can't begin, no part of it can, and a match ends with a run
        if all(len(p.lstrip("0")) <= 3 and int(p[-20:]) <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = re.sub(r"[\x20-]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found["phone"].append(m.span())
    return found


_AT = r"(?:\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?|\x20(?:at|AT)\x20)"
_DOT = r"(?:\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT)\x20|\.)"
_GENERATORS = (
    ("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}" + _AT + r"[A-Za-z0-9-]{1,63}(?:" + _DOT + r"[A-Za-z0-9-]{2,24}){1,4}")),
    ("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:" + _DOT + r"[A-Za-z0-9-]{2,24}){1,4}")),
    ("ip", re.compile(r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){2,7}:?|[0-9A-Fa-f]{1,4}::)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?(?![\w:])")),
    ("ip", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\x20?[\[({]\x20?(?:\.|dot|DOT)\x20?[\])}]\x20?[0-9]{1,3}){3}(?![\w.])")),
    ("card", re.compile(r"(?<![\w.+-])[0-9]{4}(?:[\x20.\-/]?[0-9]{3,6}){2,4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+])(?:00[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.\-/][0-9]{2,4}(?:[\x20.-][0-9]{2,5}){1,3}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+])\([0-9]{2,4}\)\x20?[0-9]{3,4}[\x20.-]?[0-9]{3,5}(?![\w-])")),
    ("phone", re.compile(r"\+\x20?\(?[0-9][\x20()./0-9-]{7,22}[0-9](?!\w)")),
)
_HINTS = {
    "email": ("mail", "contact", "write", "reach"), "ip": ("ip", "host", "server", "address", "addr", "login"),
    "card": ("card", "visa", "credit", "account", "pay", "iban"), "phone": ("tel", "phone", "call", "fax", "mobile", "whatsapp", "sms"),
}
_AGAINST = ("version", "release", "v", "isbn", "date", "order", "ticket", "serial", "hash", "token", "time", "page", "id", "build", "score", "total")
_DIGIT = re.compile(r"[0-9]")
_NEAR = re.compile(r"[^\W\d_]+")


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of the wide patterns. A pattern is left out only where the text lacks a character that all its matches have."""
    at, digits, bracket = "@" in text, _DIGIT.search(text) is not None, "[" in text or "(" in text or "{" in text
    word_at = "at" in text or "AT" in text
    can = (
        (at or word_at) and ("." in text or "dot" in text or "DOT" in text), at, text.count(":") >= 2, digits and bracket, digits, digits,
        digits and "(" in text, digits and "+" in text,
    )
    for (kind, pattern), some in zip(_GENERATORS, can):
        if some:
            for m in pattern.finditer(text):
                yield kind, *m.span()


class Taken:
    """Spans of which none overlaps another, in order; those given at first are merged where they do."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.lo, self.hi = [], []
        for lo, hi in sorted(spans):
            if self.hi and lo < self.hi[-1]:
                self.hi[-1] = max(self.hi[-1], hi)
            else:
                self.lo.append(lo)
                self.hi.append(hi)

    def free(self, lo: int, hi: int) -> bool:
        k = bisect_left(self.lo, hi)
        return not k or self.hi[k - 1] <= lo

    def add(self, lo: int, hi: int) -> None:
        k = bisect_left(self.lo, lo)
        self.lo.insert(k, lo)
        self.hi.insert(k, hi)


def measure(kind: str, text: str, lo: int, hi: int) -> list[float]:
    """A proposal's form, and the words and characters about it."""
    span = text[lo:hi]
    digits = "".join(c for c in span if c.isdigit())
    groups = re.findall(r"[0-9]+", span)
    before, after = text[max(0, lo - 40) : lo].lower(), text[hi : hi + 20].lower()
    words = _NEAR.findall(before)[-4:]
    left, right = text[lo - 1] if lo else " ", text[hi] if hi < len(text) else " "
    separators = {c for c in span if not c.isalnum()}
    lowered = span.lower()
    tail = lowered.rsplit(".", 1)[-1] if "." in lowered else lowered.rsplit(" ", 1)[-1]
    return [
        KINDS.index(kind), len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        len({len(g) for g in groups}), len(separators), sum(c.isspace() for c in span), sum(c.isalpha() for c in span), float(luhn(digits)) if digits else 0.0,
        float(span[0] == "+"), float("(" in span), float("[" in span or "{" in span or "<" in span), float(" dot " in lowered), float(" at " in lowered),
        float("@" in span), float(any(h in w for w in words for h in _HINTS[kind])), float(any(w in _AGAINST for w in words)),
        float(left.isalnum() or left in "_=\"'#"), float(right.isalnum() or right in "_\"'%"), float(left in "$€£"), len(tail),
        float(digits[:1] == "0"), float(digits[:1] in ("3", "4", "5", "6")), len(set(digits)), span.count(":"), float("::" in span),
        float(bool(re.fullmatch(r"(19|20)\d\d[-./]\d{1,2}[-./]\d{1,2}.*|\d{1,2}[-./]\d{1,2}[-./](19|20)\d\d.*", span))), float(max(map(int, groups), default=0) > 255) if kind == "ip" else 0.0,
        float(any(h in after for h in _HINTS[kind])),
    ]


def examples(count: int, seed: int) -> Iterator[tuple[str, str, int]]:
    """(kind, text, label) drawn by rule: the text holds the span between two marks."""
    rng = random.Random(seed)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))

    def card(valid: bool) -> str:
        some = rng.choice(("0123456789", "0123456789", "0123456789", "01", "15", "40"))  # some numbers repeat few digits
        d = rng.choice("3456") + "".join(rng.choice(some) for _ in range(rng.choice((12, 14, 14, 14, 14, 15)) - 1))
        return next(x for a in "0123456789" for b in "0123456789" if luhn(x := d + a + b) == valid)

    def email() -> str:
        at = rng.choice((" at ", " [at] ", "[at]", "(at)", " (at) ", " AT ", "@", " <at> "))
        dot = rng.choice((" dot ", " [dot] ", "[dot]", "(dot)", "[.]", " DOT ")) if at in ("@", " at ", " AT ") else rng.choice((" dot ", "[dot]", ".", "(dot)"))
        return f"{word()}{rng.choice(('', '.' + word(), '_' + word(), num(2)))}{at}{word()}{rng.choice(('', num(1)))}{dot}{rng.choice(('com', 'org', 'net', 'de', 'fr', 'es', 'io', 'example' + dot + 'com'))}"

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"0{num(2)} {num(2)} {num(2)} {num(2)} {num(2)}", f"0049 {num(3)} {num(3)} {num(4)}", f"0{num(3)}/{num(3)} {num(4)}", f"+1/{a}/{b}-{c}", f"1-{a}-{b}-{c}"))

    def ip() -> str:
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        dot = rng.choice(("[.]", "(.)", "[dot]", " [.] "))
        return rng.choice((dot.join(parts), ":".join(hexa(rng.randint(1, 4)) for _ in range(8)), f"{hexa(4)}:{hexa(4)}::{hexa(4)}", f"fe80::{hexa(4)}:{hexa(4)}:{hexa(4)}:{hexa(4)}"))

    def cards(valid: bool = True) -> str:
        d = card(valid)
        parts = (d[:4], d[4:10], d[10:]) if len(d) == 15 else (d[:4], d[4:8], d[8:12], d[12:])
        if rng.random() < 0.2:  # separators that differ
            return "".join(p + rng.choice(" -./") for p in parts[:-1]) + parts[-1]
        return rng.choice((".", ".", "/", "", " ", "-")).join(parts)

    right = {"email": email, "ip": ip, "card": cards, "phone": phone}
    wrong = {
        "email": lambda: rng.choice((f"{word()} at {word()} dot {word()}ing", f"{word()} at the dot {word()}", f"{word()}@{word()} dot", f"look at {word()}.{word()}", f"{word()} at {word()} dot the")),
        "ip": lambda: rng.choice((f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}", f"{num(1)}:{num(1)}:{num(1)}", f"{num(2)}:{num(2)}:{num(2)}:{num(2)}", f"{num(3)}[.]9{num(2)}[.]8{num(2)}[.]{num(1)}")),
        "card": lambda: rng.choice((cards(False), cards(False), f"20{num(2)}{num(2)}{num(2)}{num(6)}", f"17{num(11)}", f"978{num(10)}", f"{num(4)}.{num(4)}.{num(4)}", f"20{num(2)}-{num(4)}-{num(4)}", f"{num(4)} {num(4)} {num(4)}", f"{num(4)}/{num(4)}/{num(4)}", "0" * 16, f"1{'0' * 15}")),
        "phone": lambda: rng.choice((f"20{num(2)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.choice(('19', '20'))}{num(2)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02} {rng.randint(0, 23):02}", f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.20{num(2)} {num(2)}", f"{num(2)} {num(3)} {num(3)}", f"{num(3)}-{num(2)}-{num(2)}", f"20{num(2)}/{num(2)}/{num(2)}", f"{num(3)} {num(3)} {num(2)}", f"{num(2)}-{num(2)}-{num(4)}", f"{num(2)}.{num(3)}.{num(3)}")),
    }
    for i in range(count):
        kind, label = KINDS[i % 4], int(rng.random() < 0.5)
        span = (right if label else wrong)[kind]()
        hint = rng.choice(_HINTS[kind]) if label and rng.random() < 0.3 else rng.choice(_AGAINST) if not label and rng.random() < 0.4 else ""
        lead = " ".join(word() for _ in range(rng.randint(0, 6)))
        yield kind, f"{lead} {hint}{rng.choice((' ', ': ')) if hint else ''}\0{span}\0{rng.choice((' ', '.', ',', chr(10), ')'))}{word()}", label


class Judge:
    def __init__(self, trees: Boosted, calibration: dict[str, Isotonic], least: dict[str, float]):
        self.trees, self.calibration, self.least = trees, calibration, least

    def keep(self, found: list[tuple[str, int, int]], x: list[list[float]]) -> list[tuple[float, str, int, int]]:
        raw = self.trees.raw(np.array(x, float))
        out = []
        for kind in KINDS:
            own = [i for i, f in enumerate(found) if f[0] == kind]
            for i, p in zip(own, self.calibration[kind](raw[own]).tolist() if own else ()):
                if p >= self.least[kind]:
                    out.append((p, *found[i]))
        return out


@lru_cache(1)
def train(count: int = 4000, seed: int = 11, precision: float = 0.95) -> Judge:
    """Trained on the driver, in about a second, on `count` drawn examples; a quarter is kept for calibration."""
    x, y, kinds = [], [], []
    for kind, marked, label in examples(count, seed):
        lo, hi = marked.index("\0"), marked.rindex("\0") - 1
        x.append(measure(kind, marked.replace("\0", ""), lo, hi))
        y.append(label)
        kinds.append(kind)
    xs, ys, ks = np.array(x, float), np.array(y, float), np.array(kinds)
    held = np.arange(len(ys)) // 4 % 4 == 0
    trees = Boosted(trees=40, depth=4).fit(xs[~held], ys[~held])
    calibration, least = {}, {}
    for kind in KINDS:
        own = held & (ks == kind)
        raw = trees.raw(xs[own])
        calibration[kind] = Isotonic().fit(raw, ys[own])
        p = calibration[kind](raw)
        least[kind] = min((t for t in np.unique(p) if ys[own][p >= t].mean() >= precision), default=1.1)
    return Judge(trees, calibration, least)


def find_pii(docs: DataFrame, judge: Judge, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """(id_col, base, spans[, redacted]) for each row; base and spans are arrays of (kind, start, end).

    spans has all base spans and the proposals taken, best first, that overlap none taken before. With redact,
    each span becomes its kind in brackets.

    Defined cases: null texts count as empty and have no spans; a repeated row comes out as often; a null id is
    carried along; a text of any length takes time nearly in proportion, however many spans it has; an empty table
    gives an empty one; columns that are not named are ignored.
    """

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            text = row["text"] or ""
            base = [(k, lo, hi) for k, spans in base_spans(text).items() for lo, hi in spans]
            known = set(base)
            found = [x for x in dict.fromkeys(proposals(text)) if x not in known]
            taken = list(base)
            if found:
                held = Taken([(lo, hi) for _, lo, hi in base])
                found = [x for x in found if held.free(*x[1:])]
            if found:
                for _, kind, lo, hi in sorted(judge.keep(found, [measure(k, text, a, b) for k, a, b in found]), key=lambda s: (-s[0], s[2], -s[3])):
                    if held.free(lo, hi):
                        taken.append((kind, lo, hi))
                        held.add(lo, hi)
            order = lambda s: (KINDS.index(s[0]), s[1], s[2])
            out = [row["id"], *([dict(zip(("kind", "start", "end"), s)) for s in sorted(x, key=order)] for x in (base, taken))]
            if redact:
                parts, at = [], 0
                for kind, lo, hi in sorted(taken, key=lambda s: s[1:]):
                    if lo >= at:
                        parts += (text[at:lo], f"[{kind}]")
                    at = max(at, hi)
                out.append("".join([*parts, text[at:]]))
            yield tuple(out)

    span = "array<struct<kind:string,start:long,end:long>>"
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = map_rows(src, run, f"id {id_type}, base {span}, spans {span}" + ", redacted string" * redact)
    return out.withColumnRenamed("id", id_col)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir), train())
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS]
    added = lambda kind: (F.size(F.filter("spans", lambda s: s["kind"] == kind)) - F.size(F.filter("base", lambda s: s["kind"] == kind))).cast("long").alias(f"n_added_{kind}")
    counts += [added(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))

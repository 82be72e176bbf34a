"""PII redaction: candidate spans, boosted trees, calibrated thresholds.

Generators of high recall propose spans, which may overlap. Gradient-boosted trees give each a
probability from the format of the span and the words around it; each kind has a threshold that was
calibrated on held-out spans. Overlapping selected spans are redacted as one, under the likeliest
kind. The trees are trained here, on sentences made with a fixed seed: true values of each kind, and
look-alikes (dates, versions, order numbers, card-like numbers with a wrong check digit, checksums).
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import numbered, only, slices

_SEP = r"[^\w\n]{1,6}"
_KEYWORD = r"(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)"
#: Kind, pattern, group. No span has an upper length; where a run could be scanned from each of its
#: characters, the pattern starts at the run's beginning only, so that time grows with the text.
GENERATORS: list[tuple[str, re.Pattern[str], int]] = [
    ("EMAIL", re.compile(r"(?<![\w.+%-])[\w.+%-]++@[\w-]+(?:\.[\w-]+)+"), 0),
    ("PHONE", re.compile(rf"\+\d{{1,3}}{_SEP}\d{{1,4}}(?:{_SEP}\d{{2,4}}){{1,4}}|(?:\+?\d{{1,3}}{_SEP})?(?:\(\d{{3}}|(?<!\d)\d{{3}}){_SEP}\d{{3}}{_SEP}\d{{4}}(?!\d)|(?<!\d)0\d(?:{_SEP}\d{{2}}){{4}}(?!\d)"), 0),
    ("PHONE", re.compile(r"(?<![\w.])\+?\d[\d ().-]{7,16}\d(?![\w])"), 0),
    ("IP", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"), 0),
    ("IP", re.compile(r"(?i)(?<![\w:])(?:(?:[0-9a-f]{1,4}:){4,7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6})(?![\w:])"), 0),
    ("CARD", re.compile(r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"), 0),
    ("SSN", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), 0),
    ("IBAN", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), 0),
    ("SECRET", re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{32,}(?![0-9a-fA-F])"), 0),
    ("SECRET", re.compile(rf"""(?i){_KEYWORD}[^\w\n]{{1,12}}["']?([^\s"']{{6,}})"""), 1),
    ("SECRET", re.compile(r"\b(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_\w{20,}|sk-[\w-]{16,}|xox[abprs]-[\w-]{10,}|eyJ[\w-]{8,}+\.[\w-]{8,}+\.[\w-]{8,})"), 0),
    ("SECRET", re.compile(rf"""(?i){_KEYWORD}[^\w\n"']{{1,12}}(?:"([^"\n]{{6,}})"|'([^'\n]{{6,}})')"""), 0),
    ("SECRET", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?s:.*?)-----END [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/=\s]*+)"), 0),
    ("SECRET", re.compile(rf"""(?i){_KEYWORD}[^\w\n:=]{{0,6}}[:=]+[^\S\n]*["']?([^\s"':=][^\s"']{{5,}})"""), 1),
]
QUOTED = 11  # has a group for each kind of quotes
#: Punctuation that isn't taken to belong to the end of what these generators propose.
STRIP = {0: ".,;:!?*#%&$|", 9: ".,;:", 13: ".,;:"}
KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN", "SECRET")


def _digits() -> str:
    """All decimal digits that the patterns' \\d stands for, as ranges of a class of the gates' syntax."""
    at = [c for c in range(0x110000) if chr(c).isdecimal()]
    starts = [c for i, c in enumerate(at) if i == 0 or at[i - 1] != c - 1]
    ends = [c for i, c in enumerate(at) if i + 1 == len(at) or at[i + 1] != c + 1]
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)) + "]"


_D = _digits()
#: For each generator, what every text it proposes a span for matches: its own pattern without what
#: stands around. A text without a match has no span; tested on all of the generators' own matches.
GATES: tuple[str, ...] = (
    "@",
    rf"\+{_D}{{1,3}}[^\w\n]|{_D}{{3}}[^\w\n]{{1,6}}{_D}{{3}}[^\w\n]{{1,6}}{_D}{{4}}|0{_D}[^\w\n]{{1,6}}{_D}{{2}}[^\w\n]{{1,6}}{_D}{{2}}",
    rf"{_D}(?:{_D}|[ ().-]){{7}}",
    rf"{_D}\.{_D}{{1,3}}\.{_D}{{1,3}}\.{_D}",
    "[0-9a-fA-F]:(?:[0-9a-fA-F]{1,4}:|:)",
    rf"{_D}(?:[ -]?{_D}){{12}}",
    rf"{_D}{{3}}-{_D}{{2}}-{_D}{{4}}",
    rf"[A-Z]{{2}}{_D}{{2}}",
    "[0-9a-fA-F]{32}",
    rf"(?i){_KEYWORD}",
    "AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|eyJ",
    rf"(?i){_KEYWORD}",
    "PRIVATE KEY-----",
    rf"(?i){_KEYWORD}",
)
_CONTEXT = {
    "secret": re.compile(r"(?i)token|secret|passw|pwd|key|credential"),
    "call": re.compile(r"(?i)\b(?:phone|tel|call|mobile|cell|fax|contact)"),
    "net": re.compile(r"(?i)\b(?:ip|host|server|address|login|from)\b"),
    "pay": re.compile(r"(?i)\b(?:card|visa|credit|iban|account|pay)"),
    "sum": re.compile(r"(?i)\b(?:commit|sha-?\d*|md5|checksum|hash|digest|revision|blob)\b"),
    "count": re.compile(r"(?i)\b(?:version|v|release|order|invoice|isbn|page|figure|section|total|item|no|number|date|range|between|tracking|parcel|ticket|serial|part|model|ref)\b"),
    "uuid": re.compile(r"(?i)\b(?:uu?id|guid|id|session|request|trace)\b"),
}
_UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
SCHEMA_TAIL = "n_redactions int, spans array<struct<start:int,end:int,kind:string,score:double>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    t = text.replace(" ", "")
    t = t[4:] + t[:4]
    return t.isalnum() and t.isascii() and int("".join(str(int(c, 36)) for c in t)) % 97 == 1


def candidates(text: str, numbers: Iterable[int] = range(len(GENERATORS))) -> list[tuple[int, int, int]]:
    """(start, end, generator) of all spans proposed by the generators of these numbers; they may overlap."""
    out = set()
    for no in numbers:
        _, pattern, group = GENERATORS[no]
        for m in pattern.finditer(text):
            a, b = m.span(group if no != QUOTED else m.lastindex)
            while b > a and text[b - 1] in STRIP.get(no, ""):
                b -= 1
            if b > a:
                out.add((a, b, no))
    return sorted(out)


def describe(text: str, span: tuple[int, int, int]) -> list[float]:
    a, b, no = span
    s, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 12]
    digits = "".join(c for c in s if c.isdigit() and c.isascii())
    letters = sum(c.isalpha() for c in s)
    octets = [int(x) for x in s.split(".")] if GENERATORS[no][0] == "IP" and s.replace(".", "").isdigit() and "." in s else []
    groups = re.findall(r"\d+", s)
    kind = GENERATORS[no][0]
    f = [float(kind == k) for k in KINDS] + [float(no)]
    f += [len(s), len(digits), letters, letters / len(s), len(set(s)) / len(s), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0)]
    f += [float(13 <= len(digits) <= 19 and luhn(digits)), float(bool(octets) and max(octets) <= 255), float(bool(octets) and octets[0] not in (0, 255)), float(kind == "IBAN" and mod97(s))]
    f += [float(digits[:1] == "0"), float("+" in s), float("(" in s), float("-" in s), float("." in s), float(" " in s), float("/" in s), float(any(c.isupper() for c in s)), float(any(c.islower() for c in s))]
    f += [float(bool(_CONTEXT[k].search(near))) for k in _CONTEXT for near in (before, before[-16:])]
    f += [float(bool(_UUID.fullmatch(s)))]
    f += [float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before.rstrip()[-1:] in "=:\"'"), float(before[-1:] in "$€#"), float(bool(re.match(r"(?:19|20)\d\d\D", s)))]
    return f


_NUMBERED = ("tracking", "tracking number", "order", "order number", "parcel", "ticket", "ref", "serial number", "part", "model", "invoice", "case no.")


def _word(r: random.Random) -> str:
    return "".join(r.choice(["the", "in", "er", "ou", "la", "que", "sch", "ung", "an", "re", "ti", "on", "é", "ción"]) for _ in range(r.randint(1, 4)))


def _check_digit(body: str) -> str:
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def example(r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A sentence with one value, and its true span if the value is personal or secret."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    uuid = lambda: "-".join(hexes(k) for k in (8, 4, 4, 4, 12))
    pick = r.randrange(28)
    lead, true = "", True
    if pick == 0:
        name, host = _word(r), _word(r).replace("é", "e").replace("ó", "o")
        tld = r.choice(["com", "org", "net", "de", "co.uk"])
        kind, v = "EMAIL", r.choice([f"{name}.{r.randint(0, 99)}@{host}{r.randint(1, 9)}.example.{tld}", f"{name}.{_word(r)}@{host}.{tld}", f"{name[0]}.{name[-1]}@{host[0]}.{tld}", f"{name}@{host}.{tld}"])
    elif pick in (1, 2):
        kind, v = "PHONE", r.choice([f"+{r.randint(1, 99)} ({n(3)}) {n(3)}-{n(4)}", f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"+{r.randint(1, 99)} {n(3)} {n(3)} {n(4)}", f"+{r.randint(10, 99)} {n(2)} {n(2)} {n(2)} {n(2)}", f"{n(3)}.{n(3)}.{n(4)}", f"1-{n(3)}-{n(3)}-{n(4)}", f"0{r.randint(1, 9)} {n(2)} {n(2)} {n(2)} {n(2)}"])
        lead = r.choice(["", "", "call", "phone:", "tel.", "phone number", "contact number:", "mobile", "fax"])
    elif pick in (3, 4):
        v4, v6 = ".".join(str(r.randint(1, 255)) if i == 0 else str(r.randint(0, 255)) for i in range(4)), [hexes(r.randint(1, 4)) for _ in range(8)]
        kind, v, lead = "IP", r.choice([v4] * 6 + [":".join(v6), ":".join(v6[:2]) + "::" + ":".join(v6[4:])]), r.choice(["", "", "host", "from"])
    elif pick in (5, 6):
        c = _check_digit(r.choice("3456212") + n(r.choice([14, 14, 14, 13])))
        kind, v, lead = "CARD", r.choice([c, c, c, "-".join(c[i : i + 4] for i in range(0, len(c), 4)), " ".join(c[i : i + 4] for i in range(0, len(c), 4))]), r.choice(["", "", "card"])
    elif pick == 7:
        kind, v, lead = "SSN", f"{r.randint(100, 899)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", r.choice(["", "ssn"])
    elif pick == 8:
        body = r.choice(["DE", "FR", "ES", "GB"]), n(18)
        check = 98 - int(body[1] + "".join(str(int(c, 36)) for c in body[0]) + "00") % 97
        kind, v, lead = "IBAN", f"{body[0]}{check:02d}{body[1]}", r.choice(["", "iban"])
    elif pick in (9, 10, 11):
        h = hexes(r.choice([32, 40, 40, 64, 32, 40, 40, 64, 128, r.randint(129, 600)]))
        kind, v, lead = "SECRET", h, r.choice(["token =", "secret:", "api_key =", "key =", _word(r) + " =", "", ""])
    elif pick == 12:
        kind, v, lead = "SECRET", r.choice(["AKIA" + "".join(r.choice("ABCDEFGHJK23456789") for _ in range(16)), "ghp_" + hexes(36), "sk-" + hexes(24), "ghp_" + hexes(r.randint(200, 500)), "sk-" + hexes(r.randint(150, 500)), "xoxb-" + hexes(r.randint(150, 500))]), r.choice(["", "key ="])
    elif pick == 13:
        letters = r.choice(["abcdefXYZ0123456789!@#%", "abcdefXYZ0123456789!@#%", "abcdefghijklmnopqrstuvwxyz", "ABCDEFabcdefwxyz0123456789+/"])
        n_chars = r.randint(8, 20) if r.random() < 0.7 else r.randint(100, 600)
        kind, v, lead = "SECRET", "".join(r.choice(letters) for _ in range(n_chars)), r.choice(["password:", "passwd =", "secret =", "password ="])
    elif pick == 14:
        kind, v, lead = "SECRET", uuid(), r.choice(["token =", "secret:", "api_key =", "password:", "access_key ="])
    elif pick == 15:
        kind, v, lead = "SECRET", " ".join(_word(r) for _ in range(r.randint(2, 5))) + r.choice(["", str(r.randint(0, 99))]), r.choice(["password =", "passphrase =", "secret =", "token ="])
    elif pick == 16:
        name = r.choice(["", "RSA ", "EC ", "OPENSSH "])
        body = "\n".join("".join(r.choice("ABCDEFwxyz0123456789+/") for _ in range(r.randint(20, 64))) for _ in range(r.randint(1, 20)))
        kind, v = "SECRET", f"-----BEGIN {name}PRIVATE KEY-----\n{body}\n-----END {name}PRIVATE KEY-----"
    else:
        kind, true = "", False
        wrong = n(16)
        while luhn(wrong):
            wrong = n(16)
        v, lead = r.choice([
            (wrong, ""), (wrong, ""), (wrong, "number"), (n(r.randint(6, 12)), r.choice(["order", "invoice", ""])), (f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", r.choice(["", "date"])),
            (f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1990, 2030)} {r.randint(0, 23):02d}", ""), (f"{r.randint(256, 999)}.{r.randint(0, 999)}.{r.randint(0, 255)}.{r.randint(0, 255)}", ""),
            (f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 20)}", "version"), (hexes(40), "commit"), (hexes(32), r.choice(["md5", "checksum"])), (hexes(64), "sha256"),
            (f"{r.randint(1990, 2030)} {r.randint(1990, 2030)} {r.randint(1990, 2030)}", "between"), (f"{n(2)} {n(2)} {n(2)} {n(2)}", ""), (f"{r.randint(1, 99)}.{n(12)}", ""), (f"{n(3)} {n(2)} {n(3)} {n(2)}", ""),
            (f"{_word(r)} is {_word(r)}{_word(r)}", r.choice(["the token", "a key", "the secret"])), (f"{r.randint(100, 999)}-{r.randint(100, 999)}", "page"),
            (f"{n(3)}-{n(3)}-{n(4)}", r.choice(_NUMBERED)), (f"{n(3)} {n(3)} {n(4)}", r.choice(_NUMBERED)), (f"{r.choice(('978', '979'))}-{n(1)}-{n(3)}-{n(5)}-{n(1)}", r.choice(["ISBN", "isbn", "isbn:"])), (f"{r.choice(('978', '979'))}{n(10)}", r.choice(["ISBN", "isbn"])),
            (f"{n(3)}-{n(2)}-{n(4)}", r.choice(_NUMBERED)), (uuid(), r.choice(["", "id", "uuid", "request", "session id", "trace"])), (_check_digit(n(14)), r.choice(["serial number", "tracking number", "part"])),
        ])
    junk = r.random() < 0.15
    mark = lambda w: w + "".join(r.choice("*#%&$~^|!") for _ in range(r.randint(1, 4))) if junk else w
    parts, at, shift = [mark(_word(r)) for _ in range(r.randint(0, 8))] + [mark(w) for w in lead.split()], None, 0
    text = " ".join(parts)
    quote = r.choice("\"'") if pick == 15 or (lead.endswith("=") and r.random() < 0.7) else ""
    text += (" " if text else "") + quote
    at = len(text)
    shown = " ".join(mark(w) for w in v.split(" ")) if junk and kind == "PHONE" else v
    text += shown + quote
    shift = len(shown)
    if junk and shown is not v:
        shift = len(shown.rstrip("*#%&$~^|!"))
    text += (r.choice(["### ", "** ", "|| "]) if junk and shown is v else r.choice([" ", ", ", ". "])) + " ".join(mark(_word(r)) for _ in range(r.randint(0, 8)))
    return text, [(at, at + shift, kind)] if true else []


@dataclass
class Tree:
    feature: np.ndarray
    value: np.ndarray
    leaf: np.ndarray  # 2^depth values

    def apply(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        inner = len(self.feature)
        for _ in range(inner.bit_length()):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.feature[at]] > self.value[at])
        return self.leaf[at - inner]


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int) -> Tree:
    """A full tree of the given depth by second-order gain (Chen and Guestrin 2016)."""
    inner = (1 << depth) - 1
    feature, value = np.zeros(inner, np.int64), np.full(inner, np.inf)
    at = np.zeros(len(x), dtype=np.int64)
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    for node in range(inner):
        mine = np.flatnonzero(at == node)
        if len(mine):
            g, h = grad[mine], hess[mine]
            best, total_g, total_h = 1e-9, g.sum(), h.sum()
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                lg = np.cumsum(np.bincount(binned[mine, j], weights=g, minlength=len(c) + 1))[:-1]
                lh = np.cumsum(np.bincount(binned[mine, j], weights=h, minlength=len(c) + 1))[:-1]
                gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[node], value[node] = gain[k], j, c[k]
        at[mine] = 2 * node + 1 + (x[mine, feature[node]] > value[node])
    g = np.bincount(at - inner, weights=grad, minlength=inner + 1)
    h = np.bincount(at - inner, weights=hess, minlength=inner + 1)
    return Tree(feature, value, -g / (h + 1))


@dataclass
class Model:
    trees: list[Tree]
    rate: float
    a: float  # calibration: probability = sigmoid(a * raw + b)
    b: float
    thresholds: dict[str, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = sum((t.apply(x) for t in self.trees), np.zeros(len(x))) * self.rate
        return 1 / (1 + np.exp(-np.clip(self.a * raw + self.b, -40, 40)))


def training_spans(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    r, x, y, kinds = random.Random(seed), [], [], []
    for _ in range(n):
        text, truth = example(r)
        for span in candidates(text):
            kind = GENERATORS[span[2]][0]
            hit = any(min(span[1], b) - max(span[0], a) >= 0.8 * (max(span[1], b) - min(span[0], a)) and k == kind for a, b, k in truth)
            x.append(describe(text, span)), y.append(float(hit)), kinds.append(kind)
    return np.array(x), np.array(y), kinds


@lru_cache(maxsize=2)
def train(n: int = 6000, rounds: int = 60, depth: int = 4, rate: float = 0.3, seed: int = 7) -> Model:
    """Fits on n made sentences; calibration (Platt 1999) and thresholds (best F1 by kind) on n/3 others."""
    x, y, _ = training_spans(n, seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)))[:-1] for j in range(x.shape[1])]
    raw, trees = np.zeros(len(x)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        trees.append(grow(x, p - y, p * (1 - p), cuts, depth))
        raw += rate * trees[-1].apply(x)
    model = Model(trees, rate, 1.0, 0.0, dict.fromkeys(KINDS, 0.5))
    x, y, kinds = training_spans(n // 3, seed + 1)
    raw = sum((t.apply(x) for t in trees), np.zeros(len(x))) * rate
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -40, 40)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * raw).sum() + 1e-3 * (a - 1), (p - y).sum() + 1e-3 * b])
        hess = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, g)
        a, b = min(max(a - 0.5 * da, 0.1), 3.0), b - 0.5 * db  # spans that the trees tell apart fully set no slope
    model.a, model.b = float(a), float(b)
    p = model.probability(x)
    kind = np.array(kinds)
    for k in KINDS:
        mine, best = kind == k, (-1.0, 0.5)
        for cut in np.arange(0.2, 0.81, 0.05):
            hit = ((p >= cut) & (y == 1) & mine).sum()
            f1 = 2 * hit / max(1, ((p >= cut) & mine).sum() + ((y == 1) & mine).sum())
            best = max(best, (round(f1, 6), -abs(cut - 0.5)))
            if best == (round(f1, 6), -abs(cut - 0.5)):
                model.thresholds[k] = round(float(cut), 2)
    return model


def select(text: str, model: Model, numbers: Iterable[int] = range(len(GENERATORS))) -> list[tuple[int, int, str, float]]:
    """Disjoint (start, end, kind, score) in text order."""
    spans = candidates(text, numbers)
    if not spans:
        return []
    p = model.probability(np.array([describe(text, s) for s in spans]))
    chosen = sorted((a, b, GENERATORS[no][0], float(q)) for (a, b, no), q in zip(spans, p, strict=True) if q >= model.thresholds[GENERATORS[no][0]])
    out: list[tuple[int, int, str, float]] = []
    for a, b, kind, q in chosen:
        if out and a < out[-1][1]:
            pa_, pb, pk, pq = out[-1]
            out[-1] = (pa_, max(b, pb), *((kind, q) if (q, b - a) > (pq, pb - pa_) else (pk, pq)))
        else:
            out.append((a, b, kind, q))
    return out


def redact_text(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    at, out = 0, []
    for a, b, kind, _ in spans:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(out) + text[at:]


def _run(docs: DataFrame, model: Model | None, full: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(train() if model is None else model)  # of a fixed size
    columns = docs.columns
    at_text = columns.index("text")
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                text = part.column("text")
                gates = np.stack([np.asarray(pc.fill_null(pc.match_substring_regex(text, g), False)) for g in GATES])
                some = np.flatnonzero(gates.any(axis=0))
                found = [(i, t, s) for i, t in zip(some.tolist(), text.take(pa.array(some)).to_pylist(), strict=True) if (s := select(t, m, np.flatnonzero(gates[:, i]).tolist()))]
                at = np.array([i for i, _, _ in found], dtype=np.int64)
                mask = np.zeros(len(text), bool)
                mask[at] = True
                new = pc.replace_with_mask(text, pa.array(mask), pa.array([redact_text(t, s) for _, t, s in found], text.type))
                if not full:
                    out = [new if j == at_text else part.column(j) for j in range(len(columns))]
                    if "n_chars" in columns:
                        j = columns.index("n_chars")
                        out[j] = pc.if_else(pa.array(mask), pc.utf8_length(new).cast(part.column(j).type), part.column(j))
                    yield pa.RecordBatch.from_arrays(out, schema=part.schema)
                    continue
                spans: list[list] = [[] for _ in range(len(text))]
                for i, _, s in found:
                    spans[i] = [{"start": a, "end": b, "kind": k, "score": q} for a, b, k, q in s]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), new, pa.array([len(s) for s in spans], pa.int32()), pa.array(spans, span_type)], ["doc_id", "text", "n_redactions", "spans"]
                )

    return docs.mapInArrow(run, docs.schema if not full else "doc_id bigint, text string, " + SCHEMA_TAIL)


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): the text with every selected span replaced by
    its kind in brackets, and the spans as offsets in the text that came in.

    Null text stays null, without spans; an empty text stays empty. Of overlapping spans the union is
    replaced; equal scores go to the longer span, then to the first. A null doc_id stays; repeated
    rows give repeated rows; an empty table gives no rows. Other columns are ignored, whatever their
    names. Whole texts are searched and spans have no upper length; a secret that isn't quoted ends at
    white space.
    """
    return _run(only(docs, "doc_id", "text"), model, full=True)


def redact_rows(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """`docs` with all its columns, text redacted as by redact() and n_chars, if there is such a column
    of numbers, set anew where the text changed. Every row stays, null and empty texts as they are.
    Names of columns may clash, hold dots or repeat (but text)."""
    names = docs.columns
    keep = ["text", "n_chars"] if names.count("n_chars") == 1 and isinstance(docs.schema.fields[names.index("n_chars")].dataType, T.IntegralType) else ["text"]
    return _run(numbered(docs, *keep), model, full=False).toDF(*names)

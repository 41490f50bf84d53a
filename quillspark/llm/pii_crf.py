"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The patterns give the base spans. Between them, stretches of text around digits, "@" and spelt-out addresses are cut
into tokens. A segment of at most SPAN tokens (SPELT_SPAN if it has letters) that may be an entity scores by features of the whole segment (counts and
grouping of digits, checksum, octets, separators, what stands before and after it, cue words) and by the kind of the
segment before it; any other token is a segment of its own. Dynamic programming over segments of bounded length finds
the best segmentation, boundaries and kinds together. Base spans bound the stretches and always stay.

The field is trained by conditional likelihood on sentences that a seeded generator writes, with addresses, numbers
mistyped and in other layouts (spelt-out addresses in four languages and any brackets, numbers in groups of any sizes after a
cue word), secrets that a cue word or the beginning of an issued token announces, and look-alikes (dates, versions, order
numbers, hexadecimal keys without a cue, words joined by hyphens). Beside the kinds of the patterns it finds secrets: access
tokens and keys.

Defined results: a null or empty text has no spans. Whole texts are read, in time linear in their length. Offsets are
code points, ends exclusive. Repeated rows are read each; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

#: Kinds of the field, the first BASE of them also of the patterns; NONE is the kind of other tokens.
KINDS = ["email", "ip", "card", "phone", "secret"]
BASE, SECRET, NONE = 4, 4, 5
SPAN, SPELT_SPAN, SEED, EXAMPLES, EPOCHS = 15, 40, 3, 1800, 10
#: Letters and digits of keys.
PLAIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: Digits of an entity without letters, and the least of an address of four octets with points between them.
LEAST, MOST, LEAST_IP = 7, 19, 4

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

#: A long run of letters, digits and the signs of base 64, which is one token; whole runs only, so each is read once.
KEY = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9][A-Za-z0-9_+/-]{15})(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]++={0,2}+(?!\x20?[@\[({<])"
#: The words of spelt-out addresses in four languages, bare or in brackets.
ATS, DOTS = ("at", "arroba", "arobase"), ("dot", "punkt", "point", "punto")
AT, DOT = (rf"(?i:{'|'.join(words)})" for words in (ATS, DOTS))
AT_IN, DOT_IN = (rf"[\[({{<]\x20?{word}\x20?[\])}}>]" for word in (AT, DOT))
#: A stretch that may hold an entity: a key, numbers in groups, or words around "@", "(at)", or "at" with a "dot".
STRETCH = re.compile(KEY + r"|[+(\[]?[0-9][0-9\x20()./\[\]+-]{5,}[0-9]|(?<![\w.+-])[\w.+-]+\x20?" + rf"(?:(?:{AT_IN}|@)\x20?[\w-]+(?:\.[\w-]+|\x20?{DOT_IN}\x20?[\w-]+|\x20{DOT}\x20[\w-]+)+|\b{AT}\b\x20?[\w-]+(?:\.[\w-]+)*(?:\x20{DOT}\x20[\w-]+)+)", re.ASCII)
#: Most groups of digits in an entity.
GROUPS = 6
SPELT = re.compile(rf"\b{DOT}\b|{AT_IN}|@")
SPELT_AT = re.compile(rf"@|{AT_IN}|\x20{AT}\x20.*\x20{DOT}\x20")
TOKEN = re.compile(KEY + r"|[0-9]+|[^\W\d_]+|\s+|.", re.S)
#: How tokens of well-known services begin.
ISSUED = re.compile(r"(?:gh[pousr]_|github_pat_|glpat-|sk[_-]|pk_|rk_|xox[a-z]-|AKIA|ASIA|AIza|npm_|hf_)")
BRACKETS = str.maketrans("[{<]}>", "((()))")
CUES = {"phone": {"phone", "ph", "tel", "tél", "tlf", "call", "mobile", "mob", "fax", "cell", "telefon", "telefono", "teléfono", "telephone", "téléphone", "handy", "móvil", "movil", "portable", "whatsapp", "sms", "hotline", "dial", "ring", "llame", "appelez"}, "card": {"card", "visa", "mastercard", "amex", "diners", "karte", "carte", "tarjeta", "payment"}, "ip": {"ip", "host", "server", "address", "ping"}, "email": {"mail", "email", "contact", "write", "reach"}, "secret": {"token", "secret", "key", "apikey", "password", "passwd", "pwd", "bearer", "auth"}, "other": {"order", "invoice", "ref", "no", "id", "version", "isbn", "date", "total", "item", "page", "pages", "section"}}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(DIGITS.findall(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns, in order."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if DIGITS.search(text):
        out += [(*m.span(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((*m.span(), 2))
        out += [(*m.span(), 3) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


@dataclass
class Segment:
    begin: int
    end: int
    kind: int
    features: list[str]


def _side(c: str) -> str:
    return "edge" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c if c in "$#.-/=\"'" else "mark"


def candidates(text: str, tokens: list[tuple[int, int]], cue: str) -> list[Segment]:
    """Segments that may be entities, with the features of the whole span."""
    out = []
    digits_in = [b - a if text[a:b].isdigit() else 0 for a, b in tokens]
    for i, (a, _) in enumerate(tokens):
        first = text[a]
        n = groups_in = 0
        if first.isspace() or not (first.isalnum() or first in "+(["):
            continue
        b = tokens[i][1]
        if b - a >= 16 and not text[a:b].isdigit() and not text[a:b].isalpha():
            span, cued = text[a:b], f"cue={cue}"
            form = "issued" if ISSUED.match(span) else "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", span) else "mixed" if span.isalnum() else "words" if not re.search("[0-9][A-Za-z]|[a-z][A-Z]", span) else "signs"
            shared = [form, f"length={min(64, b - a) // 4}", cued, f"{cued}|{form}", f"before={_side(text[a - 1 : a])}", f"after={_side(text[b : b + 1])}", f"quoted={text[a - 1 : a] + text[b : b + 1] in (chr(34) * 2, chr(39) * 2)}|{cued}"]
            out.append(Segment(i, i + 1, SECRET, [f"{SECRET}|{f}" for f in shared]))
            continue
        letters = False
        for j in range(i + 1, min(len(tokens), i + SPELT_SPAN) + 1):
            b = tokens[j - 1][1]
            letters = letters or text[tokens[j - 1][0]].isalpha()
            if j - i > SPAN and not letters:
                break
            n += digits_in[j - 1]
            groups_in += digits_in[j - 1] > 0
            if n > 25 or groups_in > GROUPS:
                break
            if not text[b - 1].isalnum():
                continue
            span = text[a:b]
            around = [f"before={_side(text[a - 1 : a])}", f"after={_side(text[b : b + 1])}", f"cue={cue}"]
            if not letters:
                if n < LEAST_IP or n > MOST:
                    continue
                digits = _digits(span)
                groups = re.findall(r"[0-9]+", span)
                between = re.split(r"[0-9]+", span)[1:-1]
                if n < LEAST and not (len(groups) == 4 and all("." in x for x in between)):
                    continue
                marks = "".join(sorted(set(re.sub(r"[0-9]", "", span))))
                shape = ",".join(str(len(g)) for g in groups[:6])
                octets = len(groups) == 4 and all(int(g) <= 255 for g in groups)
                sure = f"{cue}|{'(' in span}|{digits[0] == '0'}"
                shared = [f"cued={cue}|{n}", f"cued={cue}|{marks}|{min(6, len(groups))}", f"cued={sure}|{n // 3}", f"lead={digits[:2]}|{n}", f"last={len(groups[-1])}|{marks}", f"sizes={min(map(len, groups))}{max(map(len, groups))}|{cue}", f"uniform={len(set(between))}", f"digits={n}", f"shape={shape}", f"marks={marks}", f"groups={min(6, len(groups))}", f"plus={first == '+'}", f"paren={'(' in span}", f"octets={octets}{'.' in span}", f"luhn={luhn(digits)}{n}", f"zero={digits[0] == '0'}", f"whole={marks}|{shape}", f"cue={cue}|{marks}|{shape}", *around]
                if octets:
                    shared.append(f"between={'|'.join(sorted(set(between)))}")
                out += [Segment(i, j, k, [f"{k}|{f}" for f in shared]) for k in ((1, 2, 3) if n >= LEAST else (1,))]
            elif first.isalnum() and SPELT_AT.search(span):
                kinds = dict.fromkeys(ATS, "AT") | dict.fromkeys(DOTS, "DOT")
                shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", lambda m: kinds.get(m[0].lower(), "w"), span)).translate(BRACKETS)
                tail = span.rsplit(".", 1)[-1].rsplit(" ", 1)[-1]
                shared = [f"shape={shape}", f"form={re.sub('[w9_.+-]+', 'x', shape)}", f"tail={min(6, len(tail))}", f"tail_letters={tail.isalpha()}", f"spaces={span.count(' ')}", *around]
                out += [Segment(i, j, 0, [f"0|{f}" for f in shared])]
    return out


def lattice(text: str, begin: int, end: int) -> tuple[list[tuple[int, int]], list[Segment]]:
    """Tokens and candidate segments of a stretch."""
    tokens = [m.span() for m in TOKEN.finditer(text, begin, end)]
    words = re.findall(r"[^\W\d_]+", text[max(0, begin - 30) : begin])
    cue = next((k for w in reversed(words[-2:]) for k, s in CUES.items() if w.lower() in s), "none")
    return tokens, candidates(text, tokens, cue)


class Field:
    """Weights of features and of pairs of neighbouring kinds (the last kind is NONE)."""

    def __init__(self) -> None:
        self.w: dict[str, float] = {}
        self.pair = np.zeros((NONE + 1, NONE + 1))

    def score(self, s: Segment) -> float:
        return sum(self.w.get(f, 0.0) for f in s.features)

    def best(self, n: int, segments: list[Segment]) -> list[Segment]:
        """The segmentation of n tokens of highest score."""
        ending: dict[int, list[Segment]] = {}
        for s in segments:
            ending.setdefault(s.end, []).append(s)
        pair = self.pair.tolist()
        top = [[-np.inf] * (NONE + 1) for _ in range(n + 1)]
        back: list[list[tuple | None]] = [[None] * (NONE + 1) for _ in range(n + 1)]
        top[0][NONE] = 0.0
        for j in range(1, n + 1):
            for y in range(NONE + 1):
                v = top[j - 1][y] + pair[y][NONE]
                if v > top[j][NONE]:
                    top[j][NONE], back[j][NONE] = v, (j - 1, y, None)
            for s in ending.get(j, ()):
                w = self.score(s)
                for y in range(NONE + 1):
                    v = top[s.begin][y] + pair[y][s.kind] + w
                    if v > top[j][s.kind]:
                        top[j][s.kind], back[j][s.kind] = v, (s.begin, y, s)
        out, j = [], n
        y = int(np.argmax(top[n]))
        while j:
            j, y, s = back[j][y]
            if s:
                out.append(s)
        return out[::-1]

    def step(self, n: int, segments: list[Segment], gold: list[Segment], rate: float) -> None:
        """One step up the conditional likelihood, by sums forward and backward."""
        w = [self.score(s) for s in segments]
        ending: dict[int, list[int]] = {}
        for k, s in enumerate(segments):
            ending.setdefault(s.end, []).append(k)
        a = np.full((n + 1, NONE + 1), -np.inf)
        a[0, NONE] = 0
        for j in range(1, n + 1):
            a[j, NONE] = np.logaddexp.reduce(a[j - 1] + self.pair[:, NONE])
            for k in ending.get(j, ()):
                s = segments[k]
                a[j, s.kind] = np.logaddexp(a[j, s.kind], np.logaddexp.reduce(a[s.begin] + self.pair[:, s.kind]) + w[k])
        total = np.logaddexp.reduce(a[n])
        b = np.full((n + 1, NONE + 1), -np.inf)
        b[n] = 0
        begins: dict[int, list[int]] = {}
        for k, s in enumerate(segments):
            begins.setdefault(s.begin, []).append(k)
        pair = np.zeros((NONE + 1, NONE + 1))
        for j in range(n - 1, -1, -1):
            b[j] = self.pair[:, NONE] + b[j + 1, NONE]
            pair[:, NONE] -= np.exp(np.minimum(0, a[j] + self.pair[:, NONE] + b[j + 1, NONE] - total))
            for k in begins.get(j, ()):
                s = segments[k]
                rest = self.pair[:, s.kind] + w[k] + b[s.end, s.kind]
                b[j] = np.logaddexp(b[j], rest)
                p = np.exp(np.minimum(0, a[j] + rest - total))
                pair[:, s.kind] -= p
                q = float(p.sum())
                if q > 1e-4:
                    for f in s.features:
                        self.w[f] = self.w.get(f, 0.0) - rate * q
        at, y = 0, NONE
        for s in [*gold, None]:
            stop = s.begin if s else n
            for _ in range(at, stop):
                pair[y, NONE] += 1
                y = NONE
            if s:
                pair[y, s.kind] += 1
                for f in s.features:
                    self.w[f] = self.w.get(f, 0.0) + rate
                at, y = s.end, s.kind
        self.pair += rate * pair


def _sentence(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A written sentence and its entities."""
    word = lambda lo=2, hi=9: "".join(r.choice("aeinorstldhum") for _ in range(r.randint(lo, hi)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    nz = lambda n: r.choice("123456789") + num(n - 1)
    grouped = lambda d, sizes, sep: sep.join(d[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes)))
    text, spans = "", []
    for _ in range(r.randint(1, 3)):
        after = ""
        for _ in range(r.randint(0, 4)):
            text += word() + r.choice([" ", " ", ", ", ". ", " | "])
        kind = r.choice([0, 1, 2, 2, 3, 3, SECRET, NONE, NONE, NONE, NONE])
        issued = kind == SECRET and r.random() < 0.25
        cue = kind == SECRET and not (issued and r.random() < 0.4) or kind != SECRET and r.random() < 0.45
        if cue:
            said = r.choice(sorted(CUES[KINDS[kind] if kind < NONE else "other"]))
            text += r.choice([said, said.title()]) + (r.choice([" ", ": ", " is ", ". "]) if kind != SECRET else r.choice([" = ", "=", ": ", " "]))
        if kind == 0:
            host, tld = word(3, 8) + r.choice(["", num(1)]), r.choice(["com", "org", "net", "de", "fr", "edu"])
            name = word() + r.choice(["", ".", "_", "-"]) + r.choice(["", num(2), word()])
            name = name.rstrip("._-")
            labels = [host, tld] if r.random() < 0.6 else r.choice([[f"{word(3, 8)}.{host}", tld], [word(3, 8), host, tld], [host, "co", "uk"], [f"{word(3, 8)}.{host}", "co", "uk"]])
            at, dot = r.choice(ATS), r.choice(DOTS)
            pad, inner, bracket = r.choice(["", " "]), r.choice(["", "", "", " "]), r.choice(["()", "[]", "{}", "<>"])
            closed = lambda w: f"{pad}{bracket[0]}{inner}{w}{inner}{bracket[1]}{pad}"
            at, dot = r.choice([(f" {at} ", f" {dot} "), (closed(at), closed(dot)), (closed(at), closed(dot)), (closed(at), "."), (" @ ", ".")])
            s = name + at + dot.join(labels)
            s = s.upper() if r.random() < 0.1 else name + at.upper() + dot.upper().join(labels) if r.random() < 0.15 else s
        elif kind == 1:
            most = r.choice([9, 99, 255, 255, 255])
            o = [str(r.randint(0, r.choice([9, most]))) for _ in range(4)]
            s = r.choice([".", "[.]", " . ", "(.)"]).join(o)
        elif kind == 2:
            sizes = r.choice([[4, 4, 4, 4], [4, 4, 4, 4], [4, 6, 5], [4, 6, 4], [4, 4, 4, 4, 3]])
            lead = r.choice(["34", "37"]) if sizes[1] == 6 and sizes[2] == 5 and cue else nz(2)
            s = grouped(lead + num(sum(sizes) - 2), sizes, r.choice(["", "", " ", "-"]))
            if r.random() < 0.2:
                s = "0" + s[1:]
        elif kind == 3:
            a, b, c = nz(3), nz(3), num(4)
            sign = r.choice(" -./")
            s = r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1{sign}{a}{sign}{b}{sign}{c}", f"0{nz(3)} {nz(7)}", f"0{nz(2)}/{nz(7)}", f"00{nz(2)} {nz(3)} {nz(7)}", f"+{nz(2)}/{nz(3)}/{nz(6)}", f"{a} {b} {c}"])
            if cue and r.random() < 0.6:  # groups of any sizes, with or without a land's number
                sizes = r.choice([[3, 4], [2, 3, 2, 2], [3, 2, 2, 2], [3, 3, 3], [5, 5], [4, 4], [2, 4, 4], [3, 5], [4, 6], [3, 7], [2, 2, 2, 2, 2], [4, 3, 3], [3, 3, 2, 2], [8], [9], [10], [11]])
                s = grouped(r.choice(["0", nz(1), nz(1)]) + num(sum(sizes) - 1), sizes, sign if len(sizes) > 1 else "")
                s = (r.choice([f"00{nz(2)} ", "(0)"]) if r.random() < 0.2 and sign == " " and len(sizes) < 6 else "") + s
        elif kind == SECRET:
            letters = r.choice(["0123456789abcdef", "0123456789abcdef", "0123456789ABCDEF", PLAIN, PLAIN, PLAIN + "+/", PLAIN + "-_"])
            s = "".join(r.choice(letters) for _ in range(r.choice([16, 20, 24, 32, 40, 40, 64])))
            s = s[:5] + "7e" + s[7:]  # holds a digit and a letter
            s = s if s[0].isalnum() else "x" + s[1:]
            s = r.choice(["ghp_", "glpat-", "sk-", "sk_live_", "xoxb-", "AKIA", "npm_"]) + s if issued else s + r.choice(["", "=", "=="]) if "+" in letters else s
            if r.random() < 0.6:
                text, after = text + '"', '"'
        else:
            y, m, d = r.randint(1900, 2099), r.randint(1, 12), r.randint(1, 28)
            if cue and r.random() < 0.2:
                text = text.rstrip() + " sha256 "
            sizes = r.choice([[3, 3, 3], [2, 3, 3], [1, 3, 3], [3, 3, 4], [4, 4], [5, 5], [2, 2, 2, 2]])
            s = r.choice([f"{y}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{y}-{y + 1}", nz(7), nz(8), nz(9), nz(10), nz(11), f"{r.randint(1, 9)}.{num(1)}.{num(2)}.{num(4)}", "".join(r.choice("0123456789abcdef") for _ in range(40)), f"{y}-{m:02d}-{d:02d} {num(2)}:{num(2)}", f"{nz(3)}.{num(3)}.{num(3)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", word(3, 6) + nz(16) + word(1, 3), grouped(nz(sum(sizes)), sizes, " "), *([grouped(nz(sum(sizes)), sizes, r.choice(" -.")), nz(10)] if cue else [f"{num(1)}-{num(3)}-{num(5)}-{num(1)}"]), "-".join([word(4), word(4), word(4), str(y)]), "/".join([word(), word(), word(), word() + num(1)]), "".join(r.choice(PLAIN) for _ in range(16)) + "4Z", f"{nz(2)} {nz(2)} {nz(2)} {nz(2)} {nz(1)}", f"{nz(1)}.{num(8)}", nz(20) + num(5), f"meet at {word()}.{word()}", f"{word()} at the dot {word()}", f"${nz(7)}.{num(2)}", *(r.choice([". ", " .", ".. ", " ", "-", "/"]).join(str(r.randint(0, most)) for _ in range(r.randint(3, 7))) for most in (9, 99) * 2)])
        if kind < NONE:
            spans.append((len(text), len(text) + len(s), kind))
        text += s + after + r.choice([" ", " ", ", ", ". ", "!! ", "### ", " | "])
    return text, spans


@lru_cache(maxsize=4)
def trained(examples: int = EXAMPLES, epochs: int = EPOCHS, seed: int = SEED) -> Field:
    r = random.Random(seed)
    rows = []
    for _ in range(examples):
        text, spans = _sentence(r)
        for a, b in stretches(text, []):
            tokens, segments = lattice(text, a, b)
            want = {s for s in spans if a <= s[0] and s[1] <= b}
            gold = [s for s in segments if (tokens[s.begin][0], tokens[s.end - 1][1], s.kind) in want]
            rows.append((len(tokens), segments, gold))
    field = Field()
    for epoch in range(epochs):
        r.shuffle(rows)
        for n, segments, gold in rows:
            field.step(n, segments, gold, 0.2 / (1 + 0.4 * epoch))
    return field


def stretches(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Parts of the text outside base spans that may hold an entity."""
    if not (DIGITS.search(text) or SPELT.search(text)):
        return []
    out, k, done = [], 0, 0  # done: the end of the base spans that begin before the stretch does
    for m in STRETCH.finditer(text):
        a = m.start()
        while True:
            while k < len(base) and base[k][0] <= a:
                done = max(done, base[k][1])
                k += 1
            a = max(a, done)
            stop = min(m.end(), base[k][0] if k < len(base) else m.end())
            if a >= m.end():
                break
            if a < stop:
                out.append((a, stop))
            a = stop
            if a == m.end():
                break
    return out


def find_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: (start, end, kind number) by start, then kind."""
    base = base_spans(text)
    more = []
    for a, b in stretches(text, base):
        tokens, segments = lattice(text, a, b)
        if segments:
            more += [(tokens[s.begin][0], tokens[s.end - 1][1], s.kind) for s in field.best(len(tokens), segments)]
    return base, sorted(base + more, key=lambda s: (s[0], s[2]))


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end), a row for each row."""
    field = trained()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [find_spans(t or "", field) for t in b.column("text").to_pylist()]
        cols = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in f[i]] for f in found], kind) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "base", "spans"])

    span = "array<struct<kind:string,start:long,end:long>>"
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, f"doc_id long, base {span}, spans {span}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets; overlapping spans become one, of the first kind. A null text stays."""
    field = trained()
    schema = docs.schema
    names = docs.columns

    def cover(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for s, e, k in find_spans(text, field)[1]:
            if s >= at:
                out += [text[at:s], f"<{KINDS[k].upper()}>"]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([cover(t) for t in b.column(c).to_pylist()], pa.string()) if c == text_col else b.column(c) for c in names], names)

    return map_arrow(docs, run, schema)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, as counts and digests; `secrets` are the spans of no pattern's kind, `n_found` counts all."""
    found = detect(table(spark, sf_dir, "documents"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS[:BASE]]
    of = lambda secret: listed(F.filter("spans", lambda s: (s["kind"] == KINDS[SECRET]) == F.lit(secret)))
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), of(False).alias("spans"), of(True).alias("secrets"), F.size("spans").cast("long").alias("n_found"))


QUERIES = {"op10_personal_data": op10_personal_data}
ORACLES: dict[str, str] = {}

"""Operator 2: personal data by a linear-chain conditional random field over word shapes.

A token is a run of non-space characters; a sequence is a line. The features of a token are its shape, whether its
digits pass the card and address rules, and whether it is a cue word, for itself and its two neighbours. The field is
trained from the small labelled table below and decoded by Viterbi in numpy batches. Four fixed patterns (the base) are
found besides and always stay; the field adds spans that don't overlap them.

Emission scores are cached by token signature. A line all of whose tokens are of a plain signature is not decoded: it
is proved at training time that its best path has no span (see _plain_is_safe).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .crf import CRF

KINDS = ("email", "ip", "card", "phone")

# The base patterns. An e-mail is looked for from its @, which gives the same leftmost matches.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d)
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    out = []
    if "@" in text:
        free = 0
        for m in _AT.finditer(text):
            s = m.start()
            while s > free and text[s - 1] in _LOCAL_CHARS:
                s -= 1
            if s < m.start():
                out.append((0, s, m.end()))
                free = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((3, *m.span()))
    return out


# --- features ------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'`()[]{}<>,;:!?.*#$%&|/\\=~^_"
_OPEN = "\"'`[]{}<>,;:!?.*#$%&|/\\=~^_"  # a bracket or sign that begins a number is part of it
_PLAIN = re.compile(r"[^\W\d_]+")
#: Cue words by what they announce.
CUES = {
    "phone": "tel telephone phone call mobile cell fax telefon telefono téléphone teléfono appelez llame anrufen whatsapp",
    "email": "email e-mail mail mailto contact contacto kontakt courriel write",
    "card": "card visa mastercard amex credit debit karte carte tarjeta",
    "ip": "ip host server address addr ping ssh",
    "at": "at (at) [at] {at} arroba",
    "dot": "dot (dot) [dot] {dot} punkt punto point",
    "id": "invoice order no nr number ref isbn version page total room model ticket rechnung facture factura id",
}
_CUE = {w: k for k, ws in CUES.items() for w in ws.split()}
_TOP = frozenset("com org net edu gov io".split())  # noqa: SIM905


def signature(token: str) -> str:
    """What the features see of a token; equal signatures have equal features."""
    core = token.strip(_EDGE)
    if _PLAIN.fullmatch(core):
        low = core.lower()
        cue = _CUE.get(low) or _CUE.get(token.lower())
        if cue:
            return f"cue:{cue}"
        if low in _TOP:
            return "top"
        return "word" if core.islower() else "Word" if core[1:].islower() else "WORD"
    if not core:
        return "punct"
    cue = _CUE.get(token.lower()) or _CUE.get(core.lower())
    if cue:
        return f"cue:{cue}"
    core = token.strip(_OPEN)
    digits = re.sub(r"[^0-9]", "", core)
    shape = re.sub(r"[0-9]+", lambda m: "9" * min(len(m[0]), 5), core)
    shape = re.sub(r"[^\W\d_]+", "a", shape)
    flags = ""
    if 13 <= len(digits) <= 19:
        flags += "L" if luhn(digits) else "l"
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", core):
        flags += "I" if all(int(p) <= 255 for p in core.split(".")) else "i"
    if core.count(":") >= 3 and re.fullmatch(r"[0-9a-fA-F:]+", core):
        flags += "V"
    if re.fullmatch(r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}", core):
        flags += "E"
    return f"{shape}|{len(digits)}|{flags}"


def features(sig: str) -> list[str]:
    """Features of a signature at its own place."""
    if "|" not in sig:
        return [f"s={sig}"]
    shape, n, flags = sig.rsplit("|", 2)
    out = [f"shape={shape}", f"n={n}", *(f"flag={f}" for f in flags), "numeric" if int(n) else "odd"]
    if int(n) > 19:
        out.append("beyond any number")
    if int(n) and not re.search(r"a", shape):
        out.append("all-numeric")
    if shape.startswith("("):
        out.append("opens")
    if shape.startswith("+"):
        out.append("plus")
    return out


def around(sig: str, where: str) -> list[str]:
    if sig.startswith(("cue:", "^", "top")):
        return [f"{where}={sig}"]
    if "|" in sig:
        shape, n, flags = sig.rsplit("|", 2)
        return [f"{where}=n{n}", f"{where}=shape{shape}", *(f"{where}=f{f}" for f in flags)]
    return [f"{where}=plain"]


# --- the labelled table --------------------------------------------------------------------------------------------

#: Lines with {kind:value} marking personal data. <d3> stands for three random digits, <w> for a word, <card> and <bad>
#: for card numbers that pass and fail the check, <ip> and <noip> for addresses with parts up to and beyond 255.
LABELLED = """
please call {phone:(<d3>) <d3>-<d4>} before noon
tel {phone:<d3>-<d3>-<d4>} or write to us
phone : {phone:<d3>.<d3>.<d4>} <w>
my mobile is {phone:<d3> <d3> <d4>} , <w> <w>
fax {phone:(<d3>) <d3>-<d4>} <w>
Telefon {phone:0<d2> <d7>} <w> <w>
téléphone {phone:0<d1> <d2> <d2> <d2> <d2>} <w>
teléfono {phone:<d3> <d3> <d3>} <w>
<w> <w> {phone:+<d1> (<d3>) <d3>-<d4>} <w> <w>
<w> {phone:+<d2> <d3> <d7>} <w>
reach me at {phone:(<d3>) <d3>-<d4>}
<w> {email:<w>.<w>@<w>.com} <w> <w>
write to {email:<w>@<w>.<w>.org} today
<w> <w> <w>. {email:<w>.<d2>@<w><d1>.<w>.com} <w>
email {email:<w> at <w> dot com} <w>
contact {email:<w> [at] <w> [dot] org} for more
mail {email:<w> (at) <w> (dot) net} , <w>
courriel {email:<w> arroba <w> punto com}
email {email:<w> dot <w> at <w> dot com}
<w> <w> {ip:<ip>} <w> <w> <w>
server {ip:<ip>} is down
host {ip:fe80::<d3>:<d4>:<d2>ab:<d4>} <w>
ip {ip:2001:db8:<d4>:<d2>f0:<d3>:<d4>:<d4>:<d2>} <w>
<w> <w> {card:<card>} <w> <w>
card {card:<card4>} expires <w>
visa {card:<cards>} <w>
credit card {card:<cardd>} <w>
carte {card:<card4>} <w> <w>
<w> <w> <bad> <w> <w>
<w> <bad> <w>
order <bad> <w> <w>
invoice no <d7> of <w>
<w> <noip> <w> <w>
version 1.2.3.<d4> of <w>
<w> <noip> <w>
page <d3> of <d3> <w>
<w> <w> at <w> <w> <w>
he was at the <w> dot <w>
the dot at <w> is <w>
we met at <w> <w>, <w> <w>.
<w> in <d4> and <d4> <w>
total <d3>.<d2> or <d2>,<d3> <w>
<d2>:<d2> <w> <d4>-<d2>-<d2> <w>
isbn <d3>-<d1>-<d2>-<d6>-<d1> <w>
room <d3>-<d2> <w> <w>
ref <d3>-<d3> <w>
<w> <d4> | <w> | <d3>-<d4> | <w>
token = "<hex>" <w> <w>
<w> = "<hex>" <w>
<w> <w> <w> <w> <w> <w>
<W> <w> <w> <w>. <W> <w>, <w> <w>.
<W> <W> <W> <W>
<W> | <w> | <w> | <w>, | <w>.
<w>*** <w>%%% <w>&&& <w>### <w>$$$
<X>!! <X>!! <X>,!! <X>!!
<w> <w> of com <w> net <w>
contact <w> <w> for <w>
call the <w> of <w>
email is <w> and <w>
point at the punto <w>
<w> v<d1>.<d2> <w> x<d3>y
http://<w>.example.com/<w>/<d3> <w>
<w> @<w> <w> #<d3>
score <d1>-<d1> in <d2>
the card is <w> and the phone is <w>
<w> <d19><d4> <w>
server <d3> has <d2> <w>
mail <d3> <w>
tel <w> <w>
<w>. at at at at at at at <w>
<w> <w> at at dot dot at at <w>
<w> com com com org <w>
<w> <w> org <w> io <w>
phone <d2> of <d3> <w>
""".strip().split("\n")
COPIES, SEED = 6, 7


def labelled(copies: int = COPIES, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled table with its place holders filled in: (line, [(kind, start, end)])."""
    rnd = random.Random(seed)
    syllables = "an the er on ti re la de es ch ver ein sch mo lo ka ri nu ta qu ou st".split()
    word = lambda: "".join(rnd.choices(syllables, k=rnd.randint(1, 4)))
    digits = lambda n: "".join(rnd.choices("0123456789", k=n))

    def number(ok: bool) -> str:
        while True:
            x = rnd.choice("3456789") + digits(15)
            if luhn(x) == ok:
                return x

    def fill(m: re.Match) -> str:
        k = m[1]
        if k == "w":
            return word()
        if k in "WX":
            return word().capitalize() if k == "W" else word().upper()
        if k == "ip":
            return ".".join(str(rnd.randint(0, 255)) for _ in range(4))
        if k == "noip":
            parts = [rnd.randint(0, 255) for _ in range(4)]
            parts[rnd.randrange(4)] = rnd.randint(256, 999)
            return ".".join(map(str, parts))
        if k == "hex":
            return "".join(rnd.choices("0123456789abcdef", k=40))
        if k in ("card", "bad"):
            return number(k == "card")
        if k.startswith("card"):
            x = number(True)
            sep = {"card4": "-", "cards": " ", "cardd": "."}[k]
            return sep.join(x[i : i + 4] for i in range(0, 16, 4))
        return digits(int(k[1:]))

    out = []
    for _ in range(copies):
        for row in LABELLED:
            line, spans = "", []
            for piece in re.split(r"(\{\w+:[^}]*\})", row):
                m = re.fullmatch(r"\{(\w+):([^}]*)\}", piece)
                text = re.sub(r"<(\w+)>", fill, m[2] if m else piece)
                if m:
                    spans.append((m[1], len(line), len(line) + len(text)))
                line += text
            out.append((line, spans))
    return out


class Tagger:
    """The trained field with its cached emissions."""

    def __init__(self):
        labels = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
        seqs, tags = [], []
        for line, spans in labelled():
            toks = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(line)]
            sigs = [signature(t[2]) for t in toks]
            y = []
            for s, e, _ in toks:
                hit = next(((k, a) for k, a, b in spans if s < b and a < e), None)
                y.append(0 if hit is None else labels.index(("B-" if s <= hit[1] else "I-") + hit[0]))
            seqs.append([self._at(sigs, i) for i in range(len(sigs))])
            tags.append(y)
        self.crf = CRF(labels).fit(seqs, tags)
        for a, x in enumerate(labels):  # I- only after B- or I- of its kind
            for b, y in enumerate(labels):
                if y[0] == "I" and x[2:] != y[2:]:
                    self.crf.trans[a, b] = -1e4
            if x[0] == "I":
                self.crf.start[a] = -1e4
        self.rows: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.plain = {"word", "Word", "WORD", "punct"} if self._plain_is_safe() else set()
        self.seen: set[str] = set()

    @staticmethod
    def _at(sigs: list[str], i: int) -> list[str]:
        before = sigs[i - 1] if i else "^start"
        after = sigs[i + 1] if i + 1 < len(sigs) else "^end"
        return features(sigs[i]) + around(before, "before") + around(after, "after")

    def _row(self, sig: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if sig not in self.rows:
            if len(self.rows) > 100_000:
                self.rows.clear()
            c = self.crf
            self.rows[sig] = (c.score(features(sig)) if sig[0] != "^" else np.zeros(len(c.labels)), c.score(around(sig, "before")), c.score(around(sig, "after")))
        return self.rows[sig]

    def emissions(self, sigs: list[str]) -> np.ndarray:
        r = [self._row(s) for s in sigs]
        own, before, after = (np.array([x[i] for x in r]) for i in range(3))
        out = own.copy()
        out[0] += self._row("^start")[1]
        out[1:] += before[:-1]
        out[-1] += self._row("^end")[2]
        out[:-1] += after[1:]
        return out

    def _plain_is_safe(self) -> bool:
        """Is the best path of every line of plain tokens O throughout?

        gap[y] is the most that label y can gain over O on a plain token in any plain company. Then every excursion from
        O (or the start) through other labels back to O (or the end) must lose: the best value at each label is relaxed
        until it settles, which it doesn't if a cycle gains."""
        plain = ["word", "Word", "WORD", "punct"]
        c = self.crf
        gap = np.full(len(c.labels), -np.inf)
        for own in plain:
            for before in [*plain, "^start"]:
                for after in [*plain, "^end"]:
                    e = self._row(own)[0] + self._row(before)[1] + self._row(after)[2]
                    gap = np.maximum(gap, e - e[0])
        stay = c.trans[0, 0]
        value = np.maximum(c.trans[0] - stay, c.start - c.start[0])[1:] + gap[1:]
        for _ in range(2 * len(c.labels)):
            step = (value[:, None] + c.trans[1:, 1:] - stay).max(axis=0) + gap[1:]
            new = np.maximum(value, step)
            if np.array_equal(new, value):
                back = np.maximum(c.trans[1:, 0] - stay, c.end[1:] - c.end[0])
                return bool((value + back).max() < 0)
            value = new
        return False

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) per text, from the field alone."""
        jobs, ems = [], []
        for n, text in enumerate(texts):
            at = 0
            for line in text.split("\n"):
                if not self._is_plain(line):
                    toks = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(line)]
                    if toks:
                        jobs.append((n, at, toks))
                        ems.append(self.emissions([signature(t[2]) for t in toks]))
                at += len(line) + 1
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for (n, at, toks), path in zip(jobs, self.crf.viterbi(ems), strict=True):
            for i in np.nonzero(path)[0]:
                if path[i] % 2 == 0:
                    continue
                j = i
                while j + 1 < len(path) and path[j + 1] == path[i] + 1:
                    j += 1
                kind = (int(path[i]) - 1) // 2
                s, e = _trim(texts[n], at + toks[i][0], at + toks[j][1], kind)
                if s < e:
                    out[n].append((kind, s, e))
        return out

    def _is_plain(self, line: str) -> bool:
        seen = self.seen
        for t in line.split():
            if t not in seen:
                if signature(t) not in self.plain:
                    return False
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(t)
        return True


def _trim(text: str, s: int, e: int, kind: int) -> tuple[int, int]:
    edge = _OPEN if kind == 3 else _EDGE
    while s < e and text[s] in edge:
        s += 1
    while s < e and text[e - 1] in _EDGE:
        e -= 1
    return s, e


@lru_cache(maxsize=1)
def tagger() -> Tagger:
    """Trained once per Python process, from the labelled table alone (under a second)."""
    return Tagger()


def find(texts: list[str | None]) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, end, base) per text, by kind, then start. The field's spans that overlap a base span are dropped."""
    plain = [t or "" for t in texts]
    out = []
    for text, added in zip(plain, tagger().spans(plain), strict=True):
        base = base_spans(text)
        if added:
            taken = sorted((s, e) for _, s, e in base)
            added = [x for x in added if not any(s < x[2] and x[1] < e for s, e in taken)]
        out.append(sorted([(*x, True) for x in base] + [(*x, False) for x in added]))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and pii: array of struct(kind, start, end, value, base) for each row of docs (doc_id, text).

    By kind in the order of KINDS, then start; code points, end exclusive. Null texts are read as empty and have no
    spans; other columns are ignored; repeated rows give repeated results; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("base", pa.bool_())])
        for b in batches:
            texts = b.column("text").to_pylist()
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "value": t[s:e], "base": x} for k, s, e, x in found] for t, found in zip(texts, find(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(kind))], names=["doc_id", "pii"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, pii array<struct<kind:string,start:int,end:int,value:string,base:boolean>>")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    d = scan(read(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("pii", lambda x: (x.kind == k) & x.base)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    base = F.filter("pii", lambda x: x.base)
    added = F.size(F.filter("pii", lambda x: ~x.base)).cast("long").alias("n_added")
    return d.select("doc_id", *[n(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), added)


def digest(text: str | None) -> str:
    """base_sha256 of one text, as the query gives it."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base_spans(text or "")).encode()).hexdigest()

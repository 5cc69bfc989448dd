"""Personal data by weak supervision.

Base spans follow fixed rules per kind (email, ip, card, phone). Beyond them,
candidates that the rules miss are put to a vote: numbers of cards and phones
inside longer digit chains that fail as a whole, phones without a country code,
and addresses written with "at" and "dot". Labelers (form, checksum, gazetteer,
context, border, neighbours) vote 1, 0 or abstain on every span. Expectation
maximisation estimates how reliable each labeler is for each kind, without any
label; the resulting probabilities train a logistic classifier of votes and
shape, and candidates it is sure of (``SURE``) are added. Base spans always stay.

Votes reach the driver as counts of distinct (kind, votes, shape) rows, of which
there are at most 4 * 3**6 * 8 whatever the size of the corpus.

Defined cases: a null or empty text has no spans. Kinds are searched one by one,
so a base span may overlap one of another kind; an added span overlaps no base
span and no other added one; of overlapping candidates the surest stays. Repeated rows get equal results and count in the
vote as often as they occur. Without candidates nothing is added. Columns named
in ``carry`` come through unchanged (one called ``spans`` as ``spans_``), others are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import by_text, list_array, steps

KINDS = ("email", "ip", "card", "phone")
#: Probability from which a candidate is added; rounds of expectation maximisation and of the classifier.
SURE, EM_ROUNDS, FIT_ROUNDS = 0.9, 60, 300
LABELERS = ("form", "checksum", "gazetteer", "context", "border", "neighbours")
SHAPES = 8

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Where ips and cards can be: from a digit on, over digits and what may join them.
ZONE = re.compile(r"[0-9][0-9.\x20-]*")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
GROUP = re.compile(r"[0-9]+")
INNER_PHONE = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(])\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}[\x20]?[\[(]at[\])][\x20]?[A-Za-z0-9-]{1,63}(?:[\x20]?[\[(]dot[\])][\x20]?[A-Za-z0-9-]{1,63}){1,8}", re.IGNORECASE)
#: What every spelled address holds.
AT = re.compile(r"at[\])]", re.IGNORECASE)
#: Digits, a plus or an at sign: without one of them there is nothing to find.
ANY = re.compile(r"[0-9@+\[(]")

#: Gazetteers and context words of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov io de fr es uk eu info example".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 81 82 86 90 91 351 353 358 420".split())
ISSUER = re.compile(r"3[47]|4|5[1-5]|2[2-7]|6(?:011|5)")
CONTEXT = {
    "email": re.compile(r"mail|contact|write|escriba|contacto|courriel|kontakt", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|host|server|address|serveur|servidor", re.IGNORECASE),
    "card": re.compile(r"card|visa|credit|carte|tarjeta|karte|payment", re.IGNORECASE),
    "phone": re.compile(r"phone|call|tel|mobile|fax|ruf|llam|appel", re.IGNORECASE),
}
NEAR = 40

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(GROUP.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", at + 1)


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and further candidates, each by place."""
    base: list[Span] = []
    more: list[Span] = []
    if not text or not ANY.search(text):
        return base, more
    base += (("email", a, b) for a, b in _emails(text))
    for zone in ZONE.finditer(text):
        if zone.end() - zone.start() < 7:
            continue
        for m in IP.finditer(text, *zone.span()):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                base.append(("ip", *m.span()))
        for m in CARD.finditer(text, *zone.span()):
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                base.append(("card", *m.span()))
            elif len(digits) > 12:
                more += (("card", a, b) for a, b in _inner_cards(text, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(len, GROUP.findall(m[0]))) <= 15:
            base.append(("phone", *m.span()))
        elif inner := INNER_PHONE.match(text, *m.span()):
            more.append(("phone", *inner.span()))
    more += (("phone", *m.span()) for m in LOCAL_PHONE.finditer(text))
    if AT.search(text):
        more += (("email", *m.span()) for m in SPELLED.finditer(text))
    base.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    more.sort(key=lambda s: (s[1], -s[2]))
    return base, more


def _inner_cards(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Numbers in a failing chain: every run of groups of 3 digits or more that has 12 to 19 digits in all."""
    groups = [m.span() for m in GROUP.finditer(text, start, end)]
    for i, (first, _) in enumerate(groups):
        digits = 0
        for a, b in groups[i:i + 6]:
            digits += b - a
            if digits > 19 or b - a < 3:
                break
            if digits >= 12:
                yield first, b


def ballot(text: str, span: Span) -> tuple[str, int]:
    """The labelers' votes ('1', '0', or '-' to abstain, in the order of LABELERS) and the span's shape."""
    kind, a, b = span
    own, before, behind = text[a:b], text[max(0, a - NEAR):a], text[b:b + NEAR]
    digits = _digits(own)
    if kind == "card":
        form, check = len(digits) == 16, luhn(digits)
        known = bool(ISSUER.match(digits))
    elif kind == "phone":
        form, check = bool(INNER_PHONE.fullmatch(own) or LOCAL_PHONE.fullmatch(own)), 9 <= len(digits) <= 15
        known = any(digits.startswith(c) for c in CALLING) if own[0] == "+" else None
    elif kind == "ip":
        form, check = all(p == "0" or p[0] != "0" for p in own.split(".")), all(int(p[-3:]) <= 255 for p in own.split("."))
        known = 1 <= int(own.split(".")[0][-3:]) <= 223
    else:
        form, check = own.count("@") <= 1, len(own) <= 254
        known = re.split(r"[^A-Za-z0-9-]+", own.rstrip("])"))[-1].lower() in TOP_DOMAINS
    border = not (before[-1:].isalnum() or behind[:1].isalnum())
    crowd = len(GROUP.findall(before)) + len(GROUP.findall(behind))
    votes = (form, check, known, True if CONTEXT[kind].search(before) else None, border, False if crowd > 4 else None)
    return "".join("-" if v is None else "01"[v] for v in votes), min(SHAPES - 1, len(GROUP.findall(own)))


def _votes_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            seen: dict[tuple[str, str, int], int] = {}
            for text in part.column("text").to_pylist():
                base, more = scan(text)
                for span in base + more:
                    row = (span[0], *ballot(text, span))
                    seen[row] = seen.get(row, 0) + 1
            yield pa.record_batch({
                "kind": pa.array([r[0] for r in seen], pa.string()), "votes": pa.array([r[1] for r in seen], pa.string()),
                "shape": pa.array([r[2] for r in seen], pa.int32()), "n": pa.array(list(seen.values()), pa.int64())})

    return docs.select("text").mapInArrow(run, "kind string, votes string, shape int, n bigint").groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n"))


def reliabilities(votes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation maximisation over ballots (-1, 0, 1; a row each, with its weight).

    Gives P(vote = 1 | class, not abstaining) as (2, labelers), and P(class 1 | ballot).
    """
    cast, yes = votes >= 0, votes == 1
    share = np.where(cast.any(1), yes.sum(1) / np.maximum(cast.sum(1), 1), 0.5)
    p = np.clip(share, 0.05, 0.95)
    rate = np.zeros((2, votes.shape[1]))
    for _ in range(EM_ROUNDS):
        for c, q in ((1, p), (0, 1 - p)):
            w = (q * weight)[:, None]
            # One made-up vote each way keeps the rates off 0 and 1; class 1 is the one that is voted for.
            rate[c] = ((w * yes).sum(0) + (1.8 if c else 0.2)) / ((w * cast).sum(0) + 2)
        prior = np.clip((p * weight).sum() / weight.sum(), 0.01, 0.99)
        odds = np.log(prior / (1 - prior)) + np.where(yes, np.log(rate[1] / rate[0]), np.where(cast, np.log((1 - rate[1]) / (1 - rate[0])), 0)).sum(1)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return rate, p


def features(kind: str, votes: str, shape: int) -> np.ndarray:
    """Per kind: a constant, each labeler's vote for and against, and the shape."""
    width = 1 + 2 * len(LABELERS) + SHAPES
    out = np.zeros(len(KINDS) * width)
    at = KINDS.index(kind) * width
    out[at] = 1
    for i, v in enumerate(votes):
        if v != "-":
            out[at + 1 + 2 * i + (v == "0")] = 1
    out[at + 1 + 2 * len(LABELERS) + shape] = 1
    return out


def fit(docs: DataFrame) -> np.ndarray:
    """Weights of the span classifier, from the ballots of all documents."""
    rows = sorted(tuple(r) for r in _votes_of(docs).collect())
    if not rows:
        return np.zeros(0)
    x = np.array([features(*r[:3]) for r in rows])
    n = np.array([r[3] for r in rows], float)
    y = np.zeros(len(rows))
    for kind in KINDS:
        at = np.array([i for i, r in enumerate(rows) if r[0] == kind], int)
        if len(at):
            ballots = np.array([["01".find(v) for v in rows[i][1]] for i in at])
            y[at] = reliabilities(ballots, n[at])[1]
    # Newton steps with a ridge: a small, convex problem.
    w = np.zeros(x.shape[1])
    share = n / n.sum() * len(rows)
    for _ in range(FIT_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + 0.01 * w
        curve = (x * (share * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 0.01 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def spans_of(text: str | None, weights: np.ndarray) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by start and kind."""
    base, more = scan(text or "")
    out = [(*s, True) for s in base]
    taken = [(a, b) for _, a, b in base]
    sure = []
    for s in more if len(weights) else []:
        if not any(a < s[2] and s[1] < b for a, b in taken):
            p = 1 / (1 + np.exp(-features(s[0], *ballot(text, s)) @ weights))
            if p >= SURE:
                sure.append((-p, s))
    # Of overlapping candidates the surest stays, then the first, then the longest.
    for _, s in sorted(sure, key=lambda x: (x[0], x[1][1], -x[1][2])):
        if not any(a < s[2] and s[1] < b for a, b in taken):
            out.append((*s, False))
            taken.append((s[1], s[2]))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find(docs: DataFrame, carry: Sequence[str] = ("doc_id",), weights: np.ndarray | None = None) -> DataFrame:
    """(carry, spans): all personal data of each whole text, in code points; the classifier is fitted if not given."""
    weights = fit(docs) if weights is None else weights

    def make(texts: pa.Array) -> list[pa.Array]:
        found = [spans_of(t, weights) for t in texts.to_pylist()]
        flat = [s for own in found for s in own]
        cells = pa.StructArray.from_arrays(
            [pa.array([s[i] for s in flat], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.bool_()))], ["kind", "start", "end", "base"])
        return [list_array(cells, np.array([len(s) for s in found], np.int64))]

    return by_text(docs, carry, f"spans {SPANS}", make)


def redact(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """The documents, all columns, with ``[KIND]`` in place of each run of overlapping spans."""
    weights = fit(docs) if weights is None else weights

    def clean(text: str | None) -> str | None:
        out, done = [], 0
        for kind, a, b, _ in spans_of(text, weights):
            if a >= done:
                out += [text[done:a], f"[{kind.upper()}]"]
            done = max(done, b)
        return "".join([*out, text[done:]]) if out else text

    # The document's own columns travel in a struct, whatever their names.
    packed = docs.select("text", F.struct("*").alias("doc"))
    found = by_text(packed, ["doc"], "clean string", lambda texts: [pa.array([clean(t) for t in texts.to_pylist()], pa.string())])
    return found.select(F.col("doc").withField("text", F.col("clean")).alias("doc")).select("doc.*")

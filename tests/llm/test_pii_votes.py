import random
import re

import numpy as np

from skysift.llm import pii_votes

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    found = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good(k, m[0])]
    return sorted(found, key=lambda s: (s[1], list(PLAIN).index(s[0])))


ODD = [None, "", "a@b.c", "x@y@z.com.", "a@b.com@c.org", "@a.b", ".a@b..c", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 4242424242424242",
       "+1 (017) 555-7713", "+1 (017) 555-7713 4736962573099581", "++49 30 1234567+", "é 1.1.1.1 é@x.yz ü", "4111  1111 1111 1111", "0" * 19, "0" * 20, "1." * 500, "1 " * 5000,
       "a." * 20000 + "@x.y", "+1" * 3000, "+1" + "(" * 3000, "0000000000001.0.0.1", "mail me (at) host (dot) com"]


def test_base_matches_rules():
    r = random.Random(4)
    made = ["".join(r.choice("0123456789 .-+()@aB%_é") for _ in range(r.randrange(60))) for _ in range(4000)]
    for t in ODD + made:
        assert pii_votes.scan(t or "")[0] == plain(t), t


def test_documents(documents, texts):
    rows = texts + [(10_000 + i, t) for i, t in enumerate(ODD)]
    got = pii_votes.find(documents(rows)).collect()
    for r in got:
        text = dict(rows)[r.doc_id]
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == plain(text)
        base = [(s.start, s.end) for s in r.spans if s.base]
        assert not any(a < s.end and s.start < b for s in r.spans if not s.base for a, b in base)
    added = {(r.doc_id, s.kind, dict(rows)[r.doc_id][s.start:s.end]) for r in got for s in r.spans if not s.base}
    assert (10_010, "card", "4242424242424242") in added and (10_012, "phone", "+1 (017) 555-7713") in added


def test_votes_estimate_reliability():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.6
    right = np.array([0.95, 0.9, 0.6, 0.8])
    votes = np.where(rng.random((4000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    rate, p = pii_votes.reliabilities(votes, np.ones(4000))
    assert np.abs(rate[1] - right).max() < 0.05
    # As good as voting with the true reliabilities.
    says = np.where(votes < 0, 0, np.where(votes == 1, 1, -1)) * np.log(right / (1 - right))
    best = ((says.sum(1) + np.log(0.6 / 0.4) > 0) == truth).mean()
    assert ((p > 0.5) == truth).mean() > best - 0.01


def test_redaction(documents):
    docs = documents(["write to a@b.com, now", "clean text", None, "", "+1 (017) 555-7713 and 10.0.0.1"])
    got = pii_votes.redact(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {0: "write to [EMAIL], now", 1: "clean text", 2: None, 3: "", 4: "[PHONE] and [IP]"}


def test_empty_table(documents):
    assert pii_votes.find(documents([])).count() == 0


def test_every_alignment_is_a_candidate():
    cards = lambda t: {t[a:b] for k, a, b in pii_votes.scan(t)[1] if k == "card"}
    assert "4111 1111 1111 1111" in cards("Paid 2024 4111 1111 1111 1111 now")
    assert "6304 0000 0000" in cards("no 12345678 6304 0000 0000")
    assert any(k == "email" for k, _, _ in pii_votes.scan("bob [At] site [dot] com")[1])
    assert any(k == "email" for k, _, _ in pii_votes.scan("bob (aT) site (DOT) com")[1])


def test_the_card_behind_a_year_is_taken(documents, texts):
    rows = texts + [(20_000, "card payment Paid 2024 4111 1111 1111 1111 now")]
    found = {r.doc_id: r for r in pii_votes.find(documents(rows)).collect()}[20_000]
    text = rows[-1][1]
    assert [text[s.start:s.end] for s in found.spans] == ["4111 1111 1111 1111"]
    clean = pii_votes.redact(documents(rows)).filter("doc_id = 20000").first().text
    assert clean == "card payment Paid 2024 [CARD] now"

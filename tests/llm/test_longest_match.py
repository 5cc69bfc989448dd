import base64
import random
import re

import numpy as np
import public_tokenizers
import pytest

from skysift.llm import longest_match


def greedy(word, vocabulary):
    n, longest = 0, max(map(len, vocabulary))
    while word:
        size = next((k for k in range(min(longest, len(word)), 0, -1) if word[:k] in vocabulary), 1)
        word, n = word[size:], n + 1
    return n


@pytest.mark.parametrize("letters", ["ab", "abc", "abcde"])
def test_small_vocabularies(letters):
    r = random.Random(len(letters))
    for _ in range(60):
        vocabulary = {"".join(r.choice(letters) for _ in range(r.randrange(1, 7))).encode() for _ in range(r.randrange(1, 25))}
        own = longest_match.Automaton(sorted(vocabulary))
        found = ["".join(r.choice(letters + "z") for _ in range(r.randrange(1, 30))).encode() for _ in range(80)]
        ends = np.cumsum([len(w) for w in found])
        got = own.counts(np.frombuffer(b"".join(found), np.uint8), ends - [len(w) for w in found], ends, blank=False)
        assert got.tolist() == [greedy(w, vocabulary) for w in found], (vocabulary, found)


def test_documents(documents, texts):
    with open(public_tokenizers.path(longest_match.RANKS), "rb") as lines:
        vocabulary = {base64.b64decode(x.split()[0]) for x in lines}
    odd = [None, "", " \n", "one", "é漢字\U0001f600", "x" * 2000, "a\x00b", "same same same", "same same same"]
    rows = texts[:80] + [(10_000 + i, t) for i, t in enumerate(odd)]
    known = {}
    for r in longest_match.token_counts(documents(rows)).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", dict(rows)[r.doc_id] or "")
        each = [known.setdefault(w, greedy(b" " + w.encode(), vocabulary)) for w in words]
        assert (r.n_words, r.n_tokens, r.longest) == (len(words), sum(each), max(each, default=0))


def test_empty_table(documents):
    assert longest_match.token_counts(documents([])).count() == 0

import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from skysift.llm import bpe_tree


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path(bpe_tree.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd():
    r = random.Random(3)
    letters = "aabbcethéßñ漢字"
    return [None, "", " ", "\n\n  \t", "a" * 30000, "".join(r.choice("ab") for _ in range(5000)), "".join(r.choice(letters) for _ in range(8000)),
            "=" * 999 + "!" * 501, "12345" * 300, "don't we'll <|endoftext|> it's", "é\U0001f600 x", "same", "same"]


def test_matches_tiktoken(documents, texts, encoding):
    rows = texts + [(10_000 + i, t) for i, t in enumerate(odd())]
    df = documents(rows)
    got = bpe_tree.decode(bpe_tree.encode(df)).toPandas().set_index("doc_id")
    assert len(got) == len(rows)
    for i, t in rows:
        assert list(got.token_ids[i]) == encoding.encode_ordinary(t or "")
        assert bytes(got.decoded[i]) == (t or "").encode()


def test_tree_equals_flat_merges(encoding):
    own = bpe_tree.codec(bpe_tree.RANKS, public_tokenizers.PATTERN)
    r = random.Random(1)
    for n in (25, 60, 300):
        for _ in range(150):
            data = bytes(r.choice(b"aethin  sS\xc3\xa9") for _ in range(n))
            assert own.tree(data) == bpe_tree.merge(data, own.ranks) == bpe_tree._merge_long(data, own.ranks)


def test_pieces_equal_pattern():
    r = random.Random(9)
    split = bpe_tree.codec(bpe_tree.RANKS, public_tokenizers.PATTERN).split
    texts = ["".join(r.choice("ab sStldmrev''  \n\t9!#éÖ\x00\x0b\x85") for _ in range(r.randrange(40))) for _ in range(4000)] + ["'s", "x's", " 's", "''s", "'re", "'r", "'ll'", "\n's"]
    data, offsets = bpe_tree.text_bytes(pa.array(texts))
    plain = bpe_tree.plain_texts(data, offsets)
    assert plain.sum() > 400 and all(p == ("\x85" not in t) for p, t in zip(plain, texts))
    texts = [t for t, p in zip(texts, plain) if p]
    data, offsets = bpe_tree.text_bytes(pa.array(texts))
    begin = bpe_tree.pieces(data, offsets)
    at = np.searchsorted(begin, offsets)
    whole = data.tobytes()
    for i, t in enumerate(texts):
        cuts = [*begin[at[i]:at[i + 1]], offsets[i + 1]]
        assert [whole[a:b].decode() for a, b in zip(cuts, cuts[1:])] == split(t), t


def test_mixed_batches_match_tiktoken(encoding):
    r = random.Random(8)
    own = bpe_tree.codec(bpe_tree.RANKS, public_tokenizers.PATTERN)
    texts = ["".join(r.choice("the 're cat's\n  99!éßÖ×÷²½漢\u3000\x1c\x1f\x85\xa0") for _ in range(r.randrange(60))) for _ in range(1500)]
    ids, counts = own.encode_all(pa.array(texts))
    at = np.cumsum(counts) - counts
    for t, a, n in zip(texts, at, counts):
        assert ids[a:a + n].tolist() == encoding.encode_ordinary(t), repr(t)


def test_empty_table(documents):
    assert bpe_tree.decode(bpe_tree.encode(documents([]))).count() == 0


def test_round_trip_in_one_pass(documents, texts, monkeypatch):
    """One Python worker a task: the pipeline's last stage has a single pass, with the rows of two."""
    import corpus_pipeline

    monkeypatch.setattr(bpe_tree, "ENCODED", 2000)
    df = documents(texts[:300] + [(10_000 + i, t) for i, t in enumerate(odd())])
    two = {r.doc_id: tuple(r) for r in bpe_tree.decode(bpe_tree.encode(df)).collect()}
    assert {r.doc_id: tuple(r) for r in bpe_tree.round_trip(df).collect()} == two
    stage = corpus_pipeline.byte_level_bpe(df.sparkSession, df, "")
    assert stage._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert stage.filter("not round_trip").count() == 0 and stage.count() == len(two)

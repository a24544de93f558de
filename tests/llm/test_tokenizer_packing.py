import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import packing, tokenizer

SCHEMA = "doc_id long, text string, ids string, tokens string"
TEXTS = [None, "", " ", "a", "Hello  world's\n\n text 123", "<|endoftext|> stays text", "日本語 ñ é 🙂👩🏽‍🔬", "a" * 30_000, "ab" * 20_000, "x y", "\r\n\t ok", "Hello  world's\n\n text 123"]
needs_files = pytest.mark.skipif(not os.path.exists(tokenizer.VOCABULARY), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer.VOCABULARY)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    with open(tokenizer.VOCABULARY, "rb") as f:
        return tokenizer.Encoder(f.read())


@needs_files
def test_ids_of_every_text(spark, reference):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r.doc_id: r.ids for r in tokenizer.encode(df).collect()}
    assert got == {i: reference.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.tokens for r in tokenizer.sizes(df).collect()} == {i: len(v) for i, v in got.items()}
    assert tokenizer.encode(df.limit(0)).collect() == []


@needs_files
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_text(reference, encoder, texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    assert encoder.encode_batch(texts) == [reference.encode(t, add_special_tokens=False).ids for t in texts]


def test_best_two_fit():
    # greedy fills 6 + 3 and leaves 1; 2 + 2 in place of the 3 close the gap
    import numpy as np

    bins = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert sorted(bins[0]) == [2, 2, 6] and sorted(bins[1]) == [3]
    rng = np.random.default_rng(1)
    for cap in (7, 64, 500):
        sizes = rng.integers(1, cap + 1, 400)
        bins = packing.best_two_fit(sizes, cap)
        assert sorted(s for b in bins for s in b) == sorted(sizes.tolist()) and all(sum(b) <= cap for b in bins)
        assert len(bins) <= 1.1 * sizes.sum() / cap + 1 if cap > 7 else True


def test_packing_keeps_every_piece(spark):
    rng = random.Random(2)
    tokens = {i: rng.choice([None, 0, 1, 5, 40, 99, 100, 101, 250, 1000]) for i in range(300)}
    sizes = spark.createDataFrame([(i, t, 0, 1) for i, t in tokens.items()], "doc_id long, tokens long, block int, position int")
    caps = spark.createDataFrame([(1, 100), (2, 64), (3, 0), (4, None)], "capacity_id int, capacity_tokens int")
    for block in (20_000, 37):
        rows = packing.pack(sizes, caps, block_items=block).collect()
        for cid, cap in ((1, 100), (2, 64)):
            mine = [r for r in rows if r.capacity_id == cid]
            pieces = {}
            for r in mine:
                pieces.setdefault(r.doc_id, []).append((r.piece, r.tokens))
            assert set(pieces) == set(tokens)
            for d, p in pieces.items():
                t = tokens[d] or 0
                p.sort()
                assert [k for k, _ in p] == list(range(len(p))) and sum(n for _, n in p) == t
                assert len(p) == 1 if t <= cap else all(n == cap for _, n in p[:-1])
            used = {}
            for r in mine:
                used.setdefault(r.container_id, []).append(r)
            assert all(sum(r.tokens for r in b) <= cap and sorted(r.position for r in b) == list(range(len(b))) for b in used.values())
        assert {r.capacity_id for r in rows} == {1, 2}
    assert packing.pack(sizes.limit(0), caps).collect() == [] and packing.pack(sizes, caps.limit(0)).collect() == []


def test_packing_checks_see_what_is_wrong(spark):
    sizes = spark.createDataFrame([(1, 6), (2, 4), (3, 5)], "doc_id long, tokens int")
    caps = spark.createDataFrame([(1, 10)], "capacity_id int, capacity_tokens int")
    good = packing.pack(sizes, caps)
    assert tuple(packing.packing_checks(good, sizes, caps).first()) == (1, 3, 0, 0, 0, 0, True)
    bad = spark.createDataFrame([(1, 1, 0, 3, 0, 0), (1, 1, 1, 3, 0, 0), (1, 2, 0, 4, 0, 1), (1, 3, 0, 4, 0, 2)], good.schema)
    assert tuple(packing.packing_checks(bad, sizes, caps).first()) == (1, 3, 1, 1, 1, 1, True)

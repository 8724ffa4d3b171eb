"""Encoding against the public library, decoding back, and containers."""

import os
import random

import pyarrow as pa
import pytest

from blockloom.llm import packing, tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="no tokenizer files here")
ALPHABET = "ab's 't\n\t 'll're'vé一ア12①.,!' 　\xa0ﾊﾞ😀ー<|endoftext|>́"
SCHEMA = "doc_id long, text string"


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["I'll don't '99 '  x", "a  \n  b", "'", "''s", "<|endoftext|>", "x" * 3000, "字" * 3000]


def test_ids_are_those_of_the_library(spark):
    rows = [(i, t) for i, t in enumerate(texts(3000))] + [(-1, None), (-2, "")]
    got = {r.doc_id: r.ids for r in tokens.encode_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[-1] == [] and got[-2] == []
    assert [got[i] for i in range(len(rows) - 2)] == library([t for _, t in rows[:-2]])


def test_merging_without_the_library():
    e = tokens.Encoder(tokens.TOKENIZERS)
    pieces = [b" hello", "こんにちは".encode(), b"aaaaaaaaab", b"'s", b"\xff\xfe"]
    for p in pieces:
        assert tokens._merge(e.ranks, p) == list(e.merge(p))


def test_round_trip_and_offsets(spark):
    rows = [(i, t) for i, t in enumerate(texts(200, 3))]
    df = spark.createDataFrame(rows, SCHEMA)
    encoded = tokens.encode_documents(df, offsets=True)
    back = {r.doc_id: r.text for r in tokens.decode_ids(encoded).collect()}
    assert back == dict(rows)
    for r in encoded.collect():
        size = len(dict(rows)[r.doc_id].encode())
        assert r.slice_ends == sorted(set(r.slice_ends)) and (r.slice_ends[-1] if size else 0) == size


def test_boundaries_of_batches():
    e = tokens.Encoder(tokens.TOKENIZERS)
    many = texts(50, 9)
    ids, at, _, _ = e.encode(pa.array(many))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == library(many)


def test_local_search_packs_well():
    rng = random.Random(4)
    import numpy as np

    sizes = np.array([rng.randint(1, 2047) for _ in range(3000)])
    bins = packing.pack(sizes, 2048)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert max(int(sizes[b].sum()) for b in bins) <= 2048
    assert len(bins) <= 1.01 * sizes.sum() / 2048 + 1
    assert len(packing.Search(np.array([3, 5, 4, 4]), [[0], [1], [2, 3]], 8).run()) == 2


def test_containers(spark):
    rng = random.Random(8)
    words = ["toy", "belt", "音声", "ボタン", "lever"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 900)))) for i in range(300)] + [(900, None), (901, "lever " * 9000), (902, "lever " * 2047 + "lever")]
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()}
    got = packing.fill_containers(df).collect()
    placed, filled = {}, {}
    for r in got:
        placed.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
        filled[r.container] = filled.get(r.container, 0) + r.n_tokens
    assert max(filled.values()) <= 2048
    assert len(filled) <= 1.02 * sum(sizes.values()) / 2048 + 1
    for doc, size in sizes.items():
        parts = sorted(placed.get(doc, []))
        assert sum(n for _, n in parts) == size and (size > 2048 or len(parts) == (size > 0))
        assert [a for a, _ in parts] == [2048 * k for k in range(len(parts))]
    assert packing.fill_containers(df.limit(0)).count() == 0

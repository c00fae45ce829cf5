from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from duotext.llm.packing import bpe_path, binary_parts, deal, encoder, pack_documents, query_packing


def test_fast_ids_equal_the_library():
    t = Tokenizer.from_file(bpe_path())
    t.encode_special_tokens = True
    fast = encoder(bpe_path()).ids
    for c in [*range(1, 0x530), *range(0x2010, 0x2028)]:
        c = chr(c)
        text = f"a{c}b {c} {c}{c}1{c}  {c}\n{c}'s{c}"
        assert fast(text).tolist() == t.encode(text, add_special_tokens=False).ids, hex(ord(c))
    for text in ["", " ", "\n\n", "日本 語 text", "<|endoftext|> a", "naïve 😀 ok", "x" * 5000]:
        assert fast(text).tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(5))
def test_deal_fills_every_sequence(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 2048, 300)
    full, left = divmod(int(lengths.sum()), 2048)
    room = [2048] * full + binary_parts(left)
    out = deal(lengths, room, 1.0, 1 / 2048)
    assert [sum(n for _, _, n in s) for s in out] == room
    parts = defaultdict(list)
    for s in out:
        for i, at, n in s:
            parts[i].append((at, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, m in sorted(parts[i]):
            assert start == at
            at += m
        assert at == n


@pytest.mark.parametrize("seed", range(20))
def test_deal_follows_the_cost_rule(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 60, int(rng.integers(1, 40)))
    full, left = divmod(int(lengths.sum()), 64)
    room = [64] * full + binary_parts(left)
    linear, quadratic = float(rng.integers(0, 3)), float(rng.integers(0, 3)) / 8
    got = deal(lengths, room, linear, quadratic)
    # Rule by rule, without arrays: descending documents, lowest cost with room, leftovers to most room.
    held = [[] for _ in room]
    free = lambda s: room[s] - sum(n for _, _, n in held[s])
    cost = lambda s: sum(linear * n + quadratic * n * n for _, _, n in held[s])
    late = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fit = [s for s in range(len(room)) if free(s) >= lengths[i]]
        if fit:
            held[min(fit, key=lambda s: (cost(s), s))].append((i, 0, int(lengths[i])))
        else:
            late.append(i)
    for i in late:
        at = 0
        while at < lengths[i]:
            s = max(range(len(room)), key=lambda s: (free(s), -s))
            take = min(int(lengths[i]) - at, free(s))
            held[s].append((i, at, take))
            at += take
    assert got == held


@pytest.mark.parametrize("text", [" " * 1_000_000 + "a", "\n" * 1_000_000 + "a", "a" * 1_000_000, "!" * 1_000_000 + " a", "a " * 60_000 + "\t \u00a0" * 20_000 + "b"])
def test_very_long_runs(text):
    t = Tokenizer.from_file(bpe_path())
    t.encode_special_tokens = True
    assert encoder(bpe_path()).ids(text).tolist() == t.encode(text, add_special_tokens=False).ids


def check(rows, texts):
    """Pieces tile the documents, sequences are gapless and full, ids are the library's."""
    t = Tokenizer.from_file(bpe_path())
    t.encode_special_tokens = True
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for d, pieces in docs.items():
        ids = np.array([*t.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_query_against_the_library(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    check(query_packing(spark, sf_small).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_nulls_empty_long_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(1, None, 7), (2, "", 7), (3, "word " * 20000, 7), (4, "日本", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset long").repartition(2)
    out = pack_documents(df, bpe_path(), pool_tokens=4096).withColumn("ids_crc32", F.crc32("ids"))
    check(out.collect(), {r[0]: r[1] for r in rows})
    assert pack_documents(df.where("doc_id < 0"), bpe_path()).count() == 0
    again = df.where("doc_id = 2").union(df.where("doc_id = 2")).withColumn("doc_id", F.lit(None).cast("long"))
    assert [(r.doc_id, r.length) for r in pack_documents(again, bpe_path()).collect()] == [(None, 1), (None, 1)]

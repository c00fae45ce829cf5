from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer, models

from duotext.llm.tokens import MARK, ForwardTrie, query_token_counts, token_counts, unigram_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library():
    pieces = unigram_pieces(PATH)
    vocab = [("<unk>", 0.0), *pieces.items(), *[(f"<0x{b:02X}>", -1e9) for b in range(256)]]
    # The library's unknown score is 10 below its least score, so byte pieces can't be in its vocabulary.
    return Tokenizer(models.Unigram(vocab[: len(pieces) + 1], unk_id=0, byte_fallback=False)), pieces


def slow_count(word, pieces):
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        options = [(best[j][0] + pieces[word[j:i]], -(-best[j][1] + 1)) for j in range(i) if word[j:i] in pieces]
        if word[i - 1] not in pieces:
            options.append((best[i - 1][0] + min(pieces.values()) - 10, best[i - 1][1] - len(word[i - 1].encode())))
        best.append(max(options))
    return -best[-1][1]


def test_counts_equal_the_library_and_share_prefixes(spark, sf_small):
    t, pieces = library()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = {r.doc_id: r for r in query_token_counts(spark, sf_small).collect()}
    assert set(got) == set(docs)
    memo = {}
    for d, text in docs.items():
        words = text.encode().split()
        assert got[d].n_pretokens == len(words)
        for w in words:
            w = MARK + w.decode()
            if w not in memo:
                ids = t.encode(w).tokens
                memo[w] = sum(1 if x in pieces else len(x.encode()) for x in ids)
        assert got[d].n_tokens == sum(memo[MARK + w.decode()] for w in words)
    trie = ForwardTrie(pieces, max_nodes=10**9)
    for w in memo:
        trie.count(w)
    assert trie.computed == len({w[: i + 1] for w in memo for i in range(len(w))})


def test_small_tries_give_the_same_counts():
    pieces = unigram_pieces(PATH)
    words = ["▁the", "▁there", "▁thereafter", "▁日本語", "▁é😀x", "▁" + "ab" * 500, "▁"]
    small, large = ForwardTrie(pieces, 3), ForwardTrie(pieces)
    for w in words:
        assert small.count(w) == large.count(w) == slow_count(w, pieces)


def test_nulls_empty_and_clashing_columns(spark):
    rows = [(None, None, 1), (2, "", 1), (3, "the the\x0bthe", 1), (3, "the the\x0bthe", 1), (4, "x" * 50000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    out = sorted(((r.doc_id or 0, r.n_pretokens, r.n_tokens) for r in token_counts(df, PATH, max_nodes=50).collect()))
    assert out[:4] == [(0, 0, 0), (2, 0, 0), (3, 3, 3), (3, 3, 3)] and out[4][1] == 1
    assert token_counts(df.where("doc_id > 9"), PATH).count() == 0

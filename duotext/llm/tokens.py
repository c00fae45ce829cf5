"""Token counts by a unigram model, with forward scores shared along a trie of pre-tokens.

A pre-token is a word with the word mark before it. Each task puts its distinct pre-tokens into a
trie. A node's forward score, the best log-probability of any split of the prefix into pieces, and
the number of pieces of that split follow from the nodes above it, so they are computed once for
all pre-tokens that share the prefix; the number at a pre-token's last node is its count. Counts of
whole pre-tokens are remembered by the task, and documents only add them up. Nothing is shuffled:
a count depends on its document and the vocabulary alone. Trie and memory are emptied at
``max_nodes`` nodes, which costs time only.

Pieces come from a public vocabulary file, whose order is the order of frequency; the
log-probability of the piece of rank r follows Zipf's law, ``-log(r + 2.7)``, normalised. Characters
without a piece of their own count their UTF-8 bytes, at ``UNKNOWN`` below the least score.
Equal scores take the split of fewer pieces.

Defined results: null and empty texts have no tokens; null ids stay null; rows that repeat are
counted one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN = 10.0


@cache
def unigram_pieces(path: str) -> dict[str, float]:
    """Log-probabilities of a sentencepiece file's ordinary pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ranked = sorted(plain, key=lambda i: -model.get_score(i))
    norm = math.log(sum(1 / (r + 2.7) for r in range(len(ranked))))
    return {model.id_to_piece(i): -math.log(r + 2.7) - norm for r, i in enumerate(ranked)}


class ForwardTrie:
    """Prefixes with their forward scores."""

    def __init__(self, pieces: dict[str, float], max_nodes: int = 400_000):
        self.pieces, self.max_nodes = pieces, max_nodes
        self.unknown = min(pieces.values()) - UNKNOWN
        self.longest: dict[str, int] = {}
        for p in pieces:
            self.longest[p[-1]] = max(self.longest.get(p[-1], 0), len(p))
        self.computed = 0
        self.clear()

    def clear(self):
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.tokens = [0.0], [0]

    def count(self, word: str) -> int:
        """The number of pieces of the best split."""
        if len(self.score) > self.max_nodes:
            self.clear()
        path, node, child = [0], 0, self.child
        for i, ch in enumerate(word):
            below = child.get((node, ch))
            if below is None:
                below = child[node, ch] = len(self.score)
                self._forward(word, i, ch, path)
            path.append(below)
            node = below
        return self.tokens[node]

    def _forward(self, word: str, i: int, ch: str, path: list[int]) -> None:
        score, tokens, pieces = self.score, self.tokens, self.pieces
        best, fewest = -math.inf, 0
        for start in range(max(0, i + 1 - self.longest.get(ch, 0)), i + 1):
            p = pieces.get(word[start : i + 1])
            if p is not None:
                s, n = score[path[start]] + p, tokens[path[start]] + 1
                if s > best or (s == best and n < fewest):
                    best, fewest = s, n
        if ch not in pieces:
            s = score[path[i]] + self.unknown
            if s > best:
                best, fewest = s, tokens[path[i]] + len(ch.encode("utf-8", "surrogatepass"))
        score.append(best)
        tokens.append(fewest)
        self.computed += 1


def _counter(path: str, max_nodes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ForwardTrie(unigram_pieces(path), max_nodes)
        known: dict[bytes, int] = {}
        for batch in batches:
            words_of, tokens_of = [], []
            for text in batch.column(1):
                words = (text.as_py() or b"").split()
                for w in sorted(set(words).difference(known)):
                    if len(known) > max_nodes:
                        break
                    known[w] = trie.count(MARK + w.decode("utf-8", "surrogatepass"))
                total = 0
                for w in words:
                    n = known.get(w)
                    total += trie.count(MARK + w.decode("utf-8", "surrogatepass")) if n is None else n
                if len(known) > max_nodes:
                    known.clear()
                words_of.append(len(words))
                tokens_of.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_of, pa.int64()), pa.array(tokens_of, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", max_nodes: int = 400_000) -> DataFrame:
    """One row per document: ``doc_id, n_pretokens, n_tokens``."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_counter(vocabulary, max_nodes), f"doc_id {dict(rows.dtypes)['doc_id']}, n_pretokens long, n_tokens long")


def query_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))

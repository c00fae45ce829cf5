"""Cost-balanced packing of documents into token sequences.

The cost of a sequence is ``linear * tokens + quadratic * sum(piece length ** 2)``, as attention
within pieces costs. Each task cuts its documents' tokens into whole sequences where a document
fills them alone (its length leaves no choice of sequence, so costs decide on the remainder only), gathers the rest up to ``pool_tokens``, and deals that pool out: pieces by
descending length, each to the sequence of lowest cost that still has room for it; what fits
nowhere whole is cut over the sequences with most room. A pool's sequences are as many of
``max_tokens`` as its tokens fill, and the tokens left over at the end of a partition make sequences
at powers of two, which need no padding. So every sequence is full.

No shuffle, and no task holds more than a batch of texts, one pool and the tokens of one document.
Sequence ids carry the partition's number, so tasks that run again give the same ids.

Defined results: null and empty texts are one piece holding the end token; null ids stay null; rows
that repeat are packed one by one; ties in length keep the order of rows; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pattern that cuts texts before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_BLANKS = 50_000
_BLANK_RUNS = re.compile(r"\s+")
PIECES = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of a byte-level BPE file of the ``tokenizers`` library.

    Texts of Latin, Greek and Cyrillic letters and common punctuation go through the same merges in
    ``tiktoken``, which is four times as fast; its pattern classes are the same for all of these code
    points (tested one by one). Other texts go through ``tokenizers``, and so do texts with a run of
    ``LONG_BLANKS`` blanks, where the pattern's look-ahead would need a very deep stack.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        special = {t.content for t in self.exact.get_added_tokens_decoder().values()}
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
        self.fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if len(text) >= LONG_BLANKS and max(map(len, _BLANK_RUNS.findall(text)), default=0) >= LONG_BLANKS:
            return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        if text.isascii() or max(text) < "԰" or all(c < "԰" or "‐" <= c <= "‧" for c in set(text)):
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if visible, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in shown else chr(extra))
        extra += b not in shown
    return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def binary_parts(n: int) -> list[int]:
    """The powers of two that make up ``n``, largest first."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def deal(lengths: np.ndarray, room: list[int], linear: float, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """For each sequence its pieces ``(item, start in the item, length)``. ``room`` sums up to the
    items' lengths, so that every sequence becomes full."""
    room = np.array(room, np.int64)
    cost = np.zeros(len(room))
    out: list[list[tuple[int, int, int]]] = [[] for _ in room]
    late = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        s = int(np.where(room >= n, cost, np.inf).argmin())
        if room[s] < n:
            late.append(item)
            continue
        out[s].append((item, 0, n))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n
    for item in late:
        at, n = 0, int(lengths[item])
        while at < n:
            s = int(room.argmax())
            take = min(n - at, int(room[s]))
            out[s].append((item, at, take))
            room[s] -= take
            at += take
    return out


def _packer(path: str, end_id: int, max_tokens: int, pool_tokens: int, linear: float, quadratic: float, shipped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(SparkFiles.get(os.path.basename(path)) if shipped else path).ids
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        pool: list[tuple] = []  # id, start, tokens, tokens of the document
        pooled, held, id_type = 0, 0, None

        def flush():
            nonlocal rows, held
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            rows, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        def dealt(last: bool):
            nonlocal pool, pooled, sequence, held
            if not pool:
                return
            full, left = divmod(pooled, max_tokens)
            room = [max_tokens] * full + binary_parts(left)
            lengths = np.array([len(p[2]) for p in pool], np.int64)
            kept = []
            for pieces, size in zip(deal(lengths, room, linear, quadratic), room, strict=True):
                if not last and size < max_tokens:
                    kept += [(pool[i][0], pool[i][1] + at, pool[i][2][at : at + n], pool[i][3]) for i, at, n in pieces]
                    continue
                offset = 0
                for i, at, n in pieces:
                    doc, start, ids, total = pool[i]
                    rows.append((doc, start + at, n, ids[at : at + n].tobytes(), total, sequence, offset))
                    offset += n
                    held += n
                sequence += 1
            pool, pooled = kept, sum(len(p[2]) for p in kept)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                total, at = len(ids), 0
                while total - at >= max_tokens:
                    rows.append((doc, at, max_tokens, ids[at : at + max_tokens].tobytes(), total, sequence, 0))
                    sequence, at, held = sequence + 1, at + max_tokens, held + max_tokens
                if at < total:
                    pool.append((doc, at, ids[at:].copy(), total))
                    pooled += total - at
                if pooled >= pool_tokens:
                    dealt(last=False)
                if held >= 4 * pool_tokens:
                    yield flush()
        if id_type is not None:
            dealt(last=True)
            yield flush()

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    max_tokens: int = 2048,
    pool_tokens: int = 1 << 19,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
) -> DataFrame:
    """Pieces of documents: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds a piece's ids as little-endian unsigned 32-bit numbers. ``tokenizer`` is the path of
    a ``tokenizers`` file that every executor has, or that ``SparkContext.addFile`` shipped
    (then give ``files:<name>``).
    """
    shipped = tokenizer.startswith("files:")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    run = _packer(tokenizer.removeprefix("files:"), end_id, max_tokens, pool_tokens, linear, quadratic, shipped)
    return rows.mapInArrow(run, PIECES.format(id=dict(rows.dtypes)["doc_id"]))


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")



def query_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), bpe_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

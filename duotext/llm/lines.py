"""Line dedup with levelled sorted runs of line hashes.

Texts are read once into an index of (document, line hash). The index is dealt into batches by
descending ids. A batch's hashes are merge-anti-joined with the runs: hashes that no run holds are
new and become a run of level 0 with the batch's largest id as their holder, which is the largest of
all, as later batches have smaller ids; hashes that a run holds give a count only, kept beside the
runs. So runs hold a hash once. ``fanout`` runs of a level are merged into one run of the next level,
so each hash is rewritten once a level. In the end runs and counts give each line's number of
documents and its holder; lines of enough documents go, except in the holder.

Runs are tables bucketed and sorted by hash, with as many buckets as shuffles have partitions: a batch,
which its grouping has dealt in the same way, meets them without an exchange.

Defined results: null and empty texts have one empty line; rows that share an id are one document, and
hold the line all if the id is the largest; null ids order before all others and count as one id; ids
are whole numbers, or text of such (others fail); an empty table gives an empty result; extra
columns are ignored; a line is compared by 128 bits of hash of its stripped and lower-cased form.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import bucketed, discard, written
from .common import attach

NO_ID = -(2**63)
HASH = ["h1", "h2"]


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """The hash of a line that is long enough to be compared."""
    key = line.strip().lower()
    if len(key) < least_chars or (not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < least_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _index(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {line_key(x, least_chars) for x in (text.as_py() or b"").split(b"\n")} - {None}
                ids += [doc] * len(own)
                keys += own
            halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc", *HASH])

    return run


def _rebuild(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, drops in zip(batch.column(1), batch.column(2), strict=True):
                lines = (text.as_py() or b"").split(b"\n")
                drops = {struct.pack("<qq", d["h1"], d["h2"]) for d in drops.as_py() or ()}
                stay = [x for x in lines if line_key(x, least_chars) not in drops] if drops else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_text"],
            )

    return run


class LineRuns:
    """Sorted runs of ``h1, h2, n, holder`` by level; ``counts`` are of later batches' documents."""

    def __init__(self, fanout: int = 2):
        self.fanout, self.levels, self.counts = fanout, [], []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, index: DataFrame) -> None:
        """A batch of ``doc, h1, h2``, a hash once a document; ids below those of all batches before."""
        batch = bucketed(index.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("holder")), "line-batch", HASH, dealt=True)
        new = batch
        for run in self.runs():
            new = new.join(run.select(*HASH).hint("merge"), HASH, "left_anti")
            # A hash is in one run at most, so no count is taken twice.
            self.counts.append(written(batch.join(run.select(*HASH).hint("merge"), HASH, "left_semi").select(*HASH, "n"), "line-counts"))
        if self.levels:
            self._place(bucketed(new, "line-run", HASH, dealt=True), 0)
            discard(batch)
        else:
            self._place(batch, 0)

    def _place(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = bucketed(_union(old), "line-run", HASH)
            discard(*old)
            self._place(merged, level + 1)

    def lines(self) -> DataFrame:
        """``h1, h2, n, holder`` with the counts of all batches."""
        counts = [c.withColumn("holder", F.lit(None).cast("long")) for c in self.counts]
        return _union(self.runs() + counts).groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("holder").alias("holder"))

    def clear(self) -> None:
        discard(*self.runs(), *self.counts)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_chars: int = 40,
    least_docs: int = 5,
    n_batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, kept_text``."""
    texts = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")
    )
    shares = [i / n_batches for i in range(n_batches - 1, 0, -1)]
    cuts = (texts.agg(F.percentile_approx("doc", shares)).first()[0] or []) if shares else []
    batch = sum(((F.col("doc") <= c).cast("int") for c in cuts), F.lit(0))
    index = texts.mapInArrow(_index(least_chars), "doc long, h1 long, h2 long")
    n, ids = texts.agg(F.count(F.lit(1)), F.count_distinct("doc")).first()
    if n != ids:  # rows that share an id are one document
        index = index.distinct()
    index = written(index.withColumn("batch", batch), "line-index", partition_by="batch")
    runs = LineRuns(fanout)
    for i in range(len(cuts) + 1):
        runs.add(index.where(F.col("batch") == i).drop("batch"))
    doomed = written(runs.lines().where(F.col("n") >= least_docs), "line-doomed")
    runs.clear()
    # A line of very many documents is a hot key of the index.
    drops = attach(index.drop("batch"), doomed, HASH, "n").where("doc != holder").groupBy("doc").agg(F.collect_set(F.struct(*HASH)).alias("drops"))
    drops = written(drops, "line-drops")
    discard(index, doomed)
    # A merge join: the plan is the same at every size.
    out = texts.join(drops.hint("merge"), "doc", "left").select("doc", "text", "drops").mapInArrow(_rebuild(least_chars), "doc_id long, n_lines long, n_dropped long, kept_text string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def query_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL_LINE_DEDUP = r"""
with l as (
  select doc_id, i, lines[i] as line,
         translate(trim(lines[i], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents))),
k as (select key, max(doc_id) as holder from l where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select l.*, k.key is not null and l.doc_id <> k.holder as gone from l left join k on l.key = k.key)
select doc_id, count(*) as n_lines, count_if(gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""

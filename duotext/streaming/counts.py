"""Structured Streaming forms of phrase counting and forced alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_markers
from ..operators.em import force_align
from ..operators.phrases import PAIR, cap_phrases, row_phrases, spans_of, valid_phrase, within
from ..operators.sliced import Model


def row_pairs(min_len: int = 1, max_len: int = 3, rule: str = "edge") -> Column:
    """The distinct consistent pairs of a row of :func:`indexed`, of both passes, as an array."""

    def one_side(side: str, low: str, high: str, back_low: str, back_high: str) -> Column:
        cut = lambda arr, lo, hi: strip_markers(F.array_join(within(arr, lo, hi), " "))

        def project(s):
            b0, b1 = F.array_min(within(low, s["a0"], s["a1"])), F.array_max(within(high, s["a0"], s["a1"]))
            return F.struct(s["a0"].alias("a0"), s["a1"].alias("a1"), b0.alias("b0"), b1.alias("b1"))

        def leads_back(s):
            ends = F.array_min(within(back_low, s["b0"], s["b1"])), F.array_max(within(back_high, s["b0"], s["b1"]))
            return s["b0"].isNotNull() & (ends[0] == s["a0"]) & (ends[1] == s["a1"])

        good = F.filter(F.transform(spans_of(side, min_len, max_len), project), leads_back)
        first, second = ("a", "b") if side == "src" else ("b", "a")
        texts = F.transform(good, lambda s: F.struct(cut("src", s[first + "0"], s[first + "1"]).alias("src_phrase"), cut("tgt", s[second + "0"], s[second + "1"]).alias("tgt_phrase")))
        return F.filter(texts, lambda t: valid_phrase(t["src_phrase"], rule) & valid_phrase(t["tgt_phrase"], rule))

    both = F.concat(one_side("src", "t_low", "t_high", "s_low", "s_high"), one_side("tgt", "s_low", "s_high", "t_low", "t_high"))
    return F.array_distinct(both)


def stream_phrase_counts(rows: DataFrame, **extraction) -> DataFrame:
    """Running number of rows per pair, for update or complete mode. Pairs are distinct inside their row
    before they are counted, so the state is one counter a pair (use the RocksDB state store);
    there is no event time, hence no watermark. A batch of one small file would be one task, so its rows are dealt out first."""
    return row_phrases(rows, **extraction).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("num_occurrences"))


def merged_counts(running: DataFrame | None, batch: DataFrame, max_phrases: int) -> DataFrame:
    """Counts so far and of a batch, capped as a whole: the lowest classes go until at most ``max_phrases`` are left."""
    both = batch if running is None else running.unionByName(batch)
    return cap_phrases(both.groupBy(*PAIR).agg(F.sum("num_occurrences").alias("num_occurrences")), max_phrases)


def stream_capped_counts(rows: DataFrame, path: str, checkpoint: str, max_phrases: int = 500_000, **extraction):
    """Running counts that never hold more than ``max_phrases`` pairs after a batch. Which pairs go depends on the
    histogram of all of them, so the running table is merged by a job a batch instead of in keyed state. It has two
    folders, ``path/0`` and ``path/1``: a batch reads the one of the batch before and replaces the other, so a
    batch that is run again after a failure gives the same table. The last batch's number is even for ``path/0``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        counts = stream_phrase_counts(batch, **extraction)
        before = batch.sparkSession.read.parquet(f"{path}/{(batch_id - 1) % 2}") if batch_id else None
        merged_counts(before, counts, max_phrases).write.mode("overwrite").parquet(f"{path}/{batch_id % 2}")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_force_align(rows: DataFrame, ttable: DataFrame | Model, mean_ratio: float, sink, checkpoint: str, tension: float = 4.0):
    """Align each micro-batch with a saved table or a model; ``sink(batch, batch_id)`` gets the aligned rows."""

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(force_align(batch, ttable, mean_ratio, tension), batch_id)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

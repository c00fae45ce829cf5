"""Quality rules: word statistics and the perplexity of a modified Kneser-Ney model per language.

Model: trigrams of code points, all of them, in every language of the corpus; there is no alphabet and no
cap, so what is counted grows with the corpus. Three code points of 21 bits fill a 63-bit code, a hash
without collisions from which shorter n-grams follow by bits. Tasks count the codes of their batches
by sorting; Spark sums them, and joins and aggregates of the n-gram tables give the discounts (orders
one to three have their own, by counts of counts), continuation counts and interpolated
probabilities. As every document is counted, each trigram to be scored is in the model, which so is one
sorted array of codes with their log-probabilities per language.

Scoring: models of at most ``most_shipped`` bytes together go to all tasks, which search the arrays; larger
ones stay a table, and the trigrams of the documents' stretches are joined with it by language
and code. Both ways give the same scores.

Verdict: a text is cut into stretches of about 64 code points. Its score is the median of the stretches'
mean negative log-probabilities, the log of its perplexity a character; the median leaves passages of
another kind (an address, a licence line, a quotation) in clean text without weight. A second score
is the log of what that makes a word. Per language, scores of all documents that pass the base
rules are counted in bins; the bands are the medians plus or minus ``width`` robust deviations (1.4826
times the median absolute deviation, at least ``least_deviation``), wider by
``sqrt(1 + least_words / n_words)`` as scores of short texts scatter more. Documents outside of
either band are rejected.

Defined results: null text has no words; documents failing the base rules are rejected whatever the
model says; null languages are one language; an empty table gives an empty result; extra columns
are ignored by :func:`quality_scores` and kept by :func:`quality_filter`; rows that repeat are
judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import bucketed, discard, written
from .common import attach

BITS = 21
STRETCH = 64
FLUSH = 1 << 22  # codes sorted together
BLANKS = b" \t\n\x0b\f\r"
MARKS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def trigram_codes(text: str) -> np.ndarray:
    """The code of each code point with the two before it; 0 stands before the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    padded = np.zeros(len(points) + 2, np.int64)
    padded[2:] = points
    padded[2:] += 1
    return (padded[:-2] << 2 * BITS) | (padded[1:-1] << BITS) | padded[2:]


def stretches(n: int) -> np.ndarray:
    """Where the stretches of ``n`` code points begin: about 64 each, all alike."""
    k = max(1, round(n / STRETCH))
    return np.arange(k) * n // k


def word_stats(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(raw.count(b) for b in BLANKS)
    symbols = sum(text.count(m) for m in MARKS)
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeat = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        # Pairs are numbered densely first: no product exceeds 63 bits in any text.
        _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        _, window, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        twice = times[window] > 1
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i : n - 2 + i] |= twice
        repeat = int(covered.sum())
    return n, chars, symbols, dup, repeat


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}

    def counted(model: str) -> pa.RecordBatch:
        codes, n = np.unique(np.concatenate(waiting.pop(model)), return_counts=True)
        del sizes[model]
        return pa.RecordBatch.from_arrays([pa.array([model] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["model", "code", "n"])

    for batch in batches:
        for model, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            codes = trigram_codes(text.as_py())
            waiting.setdefault(model, []).append(codes)
            sizes[model] = sizes.get(model, 0) + len(codes)
            if sizes[model] > FLUSH:
                yield counted(model)
        if sum(sizes.values()) > FLUSH:
            yield from map(counted, list(waiting))
    yield from map(counted, list(waiting))


def _discounts(grams: DataFrame) -> DataFrame:
    """``model, d1, d2, d3, types`` from the counts of counts; where they give none, half."""
    n = {k: F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)}
    y = F.coalesce(n[1] / F.nullif(n[1] + 2 * n[2], F.lit(0)), F.lit(0.0))
    cut = lambda k: F.when((n[k] > 0) & (n[k + 1] > 0), F.greatest(F.lit(0.0), F.least(F.lit(float(k)), k - (k + 1) * y * n[k + 1] / n[k]))).otherwise(0.5)
    return grams.groupBy("model").agg(*[cut(k).alias(f"d{k}") for k in (1, 2, 3)], F.count(F.lit(1)).alias("types"))


def _interpolated(grams: DataFrame, below: DataFrame | None, order: int) -> DataFrame:
    """``model, code, p`` of the n-grams with counts ``n``, over those of the next lower order."""
    cuts = _discounts(grams)
    rows = attach(grams, cuts, ["model"], "types")
    rows = rows.withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
    rows = rows.select("model", "code", "n", "d", F.shiftright("code", BITS).alias("context"), F.col("code").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1)).alias("suffix"))
    if below is None:
        # The lowest order has one context for all, and the uniform distribution below it.
        sums = rows.groupBy("model").agg(F.sum("n").alias("total"), F.sum("d").alias("left"), F.count(F.lit(1)).alias("types"))
        sums = sums.withColumn("q", 1 / F.col("types"))
        joined = attach(rows, sums, ["model"], "types")
    else:
        sums = rows.groupBy("model", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        lower = below.select("model", F.col("code").alias("suffix"), F.col("p").alias("q"))
        joined = rows.join(sums, ["model", "context"]).join(lower, ["model", "suffix"])
    return joined.select("model", "code", ((F.col("n") - F.col("d") + F.col("left") * F.col("q")) / F.col("total")).alias("p"))


def kneser_ney(grams: DataFrame) -> DataFrame:
    """``model, code, p`` of all trigrams ``model, code, n``: counts at order 3, numbers of distinct left
    neighbours below, the uniform distribution over the language's code points at the bottom."""
    shorter = lambda rows, order: rows.groupBy("model", F.col("code").bitwiseAND(F.lit((1 << BITS * order) - 1)).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    pairs = written(shorter(grams, 2), "quality-pairs")
    ones = written(_interpolated(shorter(pairs, 1), None, 1), "quality-ones")
    twos = written(_interpolated(pairs, ones, 2), "quality-twos")
    return _interpolated(grams, twos, 3)


def model_of(lang: Column) -> Column:
    return F.when(lang.isNull(), "=none").otherwise(F.concat(F.lit("+"), lang))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``model, code, n, nlp``: every trigram of every language with its count and negative log-probability."""
    texts = docs.select(model_of(F.col(f"`{lang_col}`").cast("string")).alias("model"), F.col(f"`{text_col}`").cast("string").alias("text")).where("length(text) > 0")
    grams = texts.mapInArrow(_count, "model string, code long, n long").groupBy("model", "code").agg(F.sum("n").alias("n"))
    grams = bucketed(grams, "quality-grams", ["model", "code"], dealt=True)
    return bucketed(grams.join(kneser_ney(grams), ["model", "code"]).select("model", "code", "n", (-F.log("p")).cast("float").alias("nlp")), "quality-model", ["model", "code"])


def _arrays(model: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language its codes in order and their values."""
    rows = model.select("model", "code", "nlp").toPandas().sort_values(["model", "code"])
    return {m: (g["code"].to_numpy(np.int64), g["nlp"].to_numpy(np.float32)) for m, g in rows.groupby("model")}


def _rows(arrays):
    """Statistics, and the score where the arrays are at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, scores = [], []
            for model, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py() or ""
                stats.append(word_stats(text))
                if arrays is None or not text:
                    scores.append(None)
                    continue
                codes, values = arrays.value[model]
                cuts = stretches(len(text))
                sums = np.add.reduceat(values[np.searchsorted(codes, trigram_codes(text))].astype(np.float64), cuts)
                scores.append(float(np.median(sums / np.diff(np.append(cuts, len(text))))))
            cols = [pa.array(c, pa.int64()) for c in (zip(*stats, strict=True) if stats else [()] * 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *cols, pa.array(scores, pa.float64())], ["doc_id", "model", "text_key", *STATS, "score"])

    return run


def _stretch_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct trigram of each stretch, per text."""
    for batch in batches:
        for key, model, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            codes = trigram_codes(text.as_py())
            of = np.zeros(len(codes), np.int64)
            of[stretches(len(codes))[1:]] = 1
            pairs, n = np.unique(np.stack([np.cumsum(of), codes], axis=1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(n), pa.string()), pa.array([model] * len(n), pa.string()), *(pa.array(x, pa.int64()) for x in (pairs[:, 0], pairs[:, 1], n))], ["text_key", "model", "stretch", "code", "times"])


def _joined_scores(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``text_key, score`` by a join with the model. Rows that repeat a text are one text here."""
    texts = rows.where("length(text) > 0").groupBy("text_key", "model").agg(F.any_value("text").alias("text"))
    grams = texts.select("text_key", "model", "text").mapInArrow(_stretch_codes, "text_key string, model string, stretch long, code long, times long")
    # A frequent trigram is in nearly all stretches; it is hot by its count.
    scored = attach(grams, model, ["model", "code"], "n")
    means = scored.groupBy("text_key", "stretch").agg((F.sum(F.col("times") * F.col("nlp").cast("double")) / F.sum("times")).alias("mean"))
    return means.groupBy("text_key").agg(F.median("mean").alias("score"))


def quality_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    least_words: int = 50,
    most_repeat: int = 50,
    width: float = 4.0,
    least_deviation: float = 0.005,
    most_shipped: int = 128 << 20,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score, lower, upper, word_score, word_lower, word_upper, kept``."""
    model = train(docs, text_col, lang_col)
    lang, text = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), model_of(lang).alias("model"), text.alias("text"))
    # Twelve bytes a trigram are shipped.
    shipped = 12 * model.count() <= most_shipped
    arrays = docs.sparkSession.sparkContext.broadcast(_arrays(model)) if shipped else None
    keyed = rows.withColumn("text_key", F.lit(None).cast("string") if shipped else F.md5(F.concat("model", F.lit("/"), F.coalesce("text", F.lit("")))))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, model string, text_key string, {', '.join(f'{c} long' for c in STATS)}, score double"
    scored = keyed.select("doc_id", "model", "text", "text_key").mapInArrow(_rows(arrays), schema)
    if not shipped:
        sizes = keyed.groupBy("text_key").agg(F.count(F.lit(1)).alias("n"))
        scored = attach(scored.drop("score"), written(_joined_scores(keyed, model).join(sizes, "text_key"), "quality-joined"), ["text_key"], "n")
    chars = F.col("word_chars") + F.greatest(F.col("n_words"), F.lit(1))
    scored = scored.select(
        "doc_id", "model", *STATS, "score",
        ((F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))).alias("base_failed"),
        F.log(F.greatest("score", F.lit(1e-6)) * chars / F.greatest(F.col("n_words"), F.lit(1))).alias("word_score"),
    )
    scored = written(scored, "quality-scores")
    discard(model)
    bands = scored.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    for score, low, high in (("score", "m", "half"), ("word_score", "word_m", "word_half")):
        bins = scored.where("not base_failed").groupBy("model", F.round(score, 3).alias("x")).agg(F.count(F.lit(1)).alias("n"))
        middle = _median(bins).withColumnRenamed("median", low)
        away = bins.join(middle, "model").groupBy("model", F.round(F.abs(F.col("x") - F.col(low)), 3).alias("x")).agg(F.sum("n").alias("n"))
        deviation = F.greatest(1.4826 * F.col("median"), F.lit(least_deviation)) * width
        bands = bands.join(middle.join(_median(away), "model").select("model", low, deviation.alias(high)), "model", "left")
    short = F.sqrt(1 + least_words / F.greatest(F.col("n_words"), F.lit(1)))
    banded = attach(scored, written(bands, "quality-bands"), ["model"], "n")
    limits = [(F.col(m) + sign * F.col(half) * short).alias(name) for m, half, names in (("m", "half", ("lower", "upper")), ("word_m", "word_half", ("word_lower", "word_upper"))) for sign, name in zip((-1, 1), names, strict=True)]
    banded = banded.select("doc_id", *STATS, "base_failed", "score", "word_score", *limits)
    inside = F.col("score").between(F.col("lower"), F.col("upper")) & F.col("word_score").between(F.col("word_lower"), F.col("word_upper"))
    return banded.select(
        "doc_id", *STATS, "base_failed", "score", "lower", "upper", "word_score", "word_lower", "word_upper",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
    )


def _median(bins: DataFrame) -> DataFrame:
    """The lower median per model of binned values; there are some ten thousand bins at most, as scores
    are logs rounded to 0.001."""
    upto = F.sum("n").over(Window.partitionBy("model").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy("model"))
    return bins.select("model", "x", upto.alias("upto"), total.alias("total")).where("2 * upto >= total").groupBy("model").agg(F.min("x").alias("median"))


def quality_filter(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The documents that stay, with all their columns. An id that stands for several texts goes
    only if none of them stays."""
    judged = quality_scores(docs, id_col, **settings).groupBy(F.col("doc_id").alias("_lost")).agg(F.bool_or("kept").alias("_kept"))
    lost = judged.where("not _kept").select("_lost")
    return docs.join(lost, docs[f"`{id_col}`"].eqNullSafe(lost["_lost"]), "left_anti")


def query_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "lower", "upper", "word_score", "word_lower", "word_upper"
    )

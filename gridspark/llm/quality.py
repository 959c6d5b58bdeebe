"""Quality by importance resampling: hashed n-gram generative models of target and raw text, sampled by Gumbel top-k.

Words and word pairs hash into 2**BITS buckets.  One pass counts them over all rows (raw model) and over rows that labels
call good and not toxic (target model); a row's log importance weight is the sum of its n-grams' log ratios.  Adding Gumbel noise,
drawn from the row's id, and keeping the k largest samples k rows without replacement by weight.  The kth largest key is
found exactly by four histogram passes over 16 bits each, so no task sorts or gathers the rows.

The target model is learnt from at most `most_labels` labelled rows, those of least hash (a documented bound; the ids go
to every task); raw counts, weights and the sample cover all rows.

Defined cases: null or empty text: weight 0, never sampled before the rest unless its noise says so.  Null ids share one noise
value.  Rows with the very key of the kth are all taken.  Without good labels all weights are 0.  Repeated rows count and are
returned as often as they come; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import ascii_lower, materialize, mix, prefix_hash, slices, span_hash, text_buffer, word_bounds

BITS, MOST_LABELS, FRACTION, SMOOTH, SEED = 14, 20_000, 0.75, 1.0, 20240607
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def ngram_buckets(column: pa.Array, bits: int):
    """(bucket, row) of every word and word pair, slice by slice."""
    ended = pc.binary_join_element_wise(column.cast(pa.large_binary()).fill_null(b""), pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    data, offsets = text_buffer(ended)
    for lo, hi in slices(offsets, 1 << 19):
        part = ascii_lower(data[offsets[lo] : offsets[hi]])
        starts, ends = word_bounds(part)
        words = span_hash(prefix_hash(part), starts, ends)
        row = np.searchsorted(offsets[lo : hi + 1] - offsets[lo], starts, side="right") - 1 + lo
        same = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
        pairs = mix(words[:-1] * _PAIR + words[1:])[same] if len(row) else words
        yield (np.concatenate([words, pairs]) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([row, row[1:][same]])


def models(docs: DataFrame, good: list[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all rows and of the good rows: 2**bits numbers each."""
    known = np.array(sorted(good), np.int64)

    def work(batches):
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            hit = np.isin(batch.column(0).fill_null(-1).to_numpy(), known) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for g, row in ngram_buckets(batch.column(1), bits):
                raw += np.bincount(g, minlength=1 << bits)
                target += np.bincount(g[hit[row]], minlength=1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 << bits)), pa.array(raw), pa.array(target)], ["g", "raw", "target"])

    sums = docs.mapInArrow(work, "g long, raw long, target long").groupBy("g").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    at = sums.column("g").to_numpy()
    raw[at], target[at] = sums.column("raw").to_numpy(), sums.column("target").to_numpy()
    return raw, target


def order_key(x: np.ndarray) -> np.ndarray:
    """Signed numbers in the order of the doubles."""
    b = (x + 0.0).view(np.int64)
    return np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b)


def kth_largest(rows: DataFrame, key: str, k: int) -> int | None:
    """The kth largest value of a long column, by histograms of 16 bits; None if there are fewer rows or k is 0."""
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        now = rows if prefix is None else rows.where(F.shiftright(F.col(key), shift + 16) == F.lit(prefix))
        found = sorted(((r["b"], r["n"]) for r in now.groupBy(F.shiftright(F.col(key), shift).alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for b, n in found:  # 65,536 at most
            if n >= left > 0:
                prefix = b
                break
            left -= n
        else:
            return None
    return prefix


def resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION, bits: int = BITS, most_labels: int = MOST_LABELS, clean: str = "quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null", seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, score, sample_key, selected) of every row; score in 0 .. 1 is the weight per n-gram on a logistic scale."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    good = [r[0] for r in labels.where(clean).select(F.col("doc_id").cast("long").alias("i")).distinct().orderBy(F.xxhash64("i"), "i").limit(most_labels).collect()]
    raw, target = models(base, good, bits)
    ratio = np.log((target + SMOOTH * (raw + 1) / (raw.sum() + len(raw))) / (target.sum() + SMOOTH)) - np.log((raw + 1) / (raw.sum() + len(raw))) if target.sum() else np.zeros(1 << bits)

    def weigh(batches):
        for batch in batches:
            n = batch.num_rows
            weight, count = np.zeros(n), np.zeros(n, np.int64)
            for g, row in ngram_buckets(batch.column(1), bits):
                weight += np.bincount(row, ratio[g], n)
                count += np.bincount(row, minlength=n)
            ids = batch.column(0).fill_null(-1).to_numpy().astype(np.uint64)
            u = (mix(mix(ids) + np.uint64(seed)) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54
            noisy = weight - np.log(-np.log(u))
            score = 1 / (1 + np.exp(-np.clip(4 * weight / np.maximum(count, 1), -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(score), pa.array(noisy), pa.array(order_key(noisy))], ["doc_id", "log_weight", "score", "sample_key", "o"])

    rows = materialize(base.mapInArrow(weigh, "doc_id long, log_weight double, score double, sample_key double, o long"), "weights")
    n = rows.count()
    least = kth_largest(rows, "o", round(fraction * n))
    taken = F.lit(False) if least is None else F.col("o") >= F.lit(least)
    return rows.select("doc_id", "log_weight", "score", "sample_key", taken.alias("selected"))

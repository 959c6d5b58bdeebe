"""Mixing sources to target weights by blocks of tokens.

Each source's documents stand in a hashed order and their words are packed into fixed-length blocks, 0 .. n-1.
Every output shard draws multinomial source counts, held to each source's total number of slots.  Slot t of a source
takes block permutation(epoch)(t mod n), epoch = t div n, a keyed Feistel permutation of 0 .. n-1 that needs no table;
slots and blocks then join by index.  Targets never exceed `most` times a source's size, so no block is taken more
often than `most` times.  The last slot of a source takes only the words still missing.

Window groups are (source, hash bucket) cells of bounded size, so a source with a third of all rows is split.
The driver sees one row per source (size), as the mix's weights do; more than MOST_SOURCES raise an error.  Everything hashes ids and seeds: reruns agree.

Defined cases: null text has size 0 and is never taken; null source is a source of its own, last in order;
null ids and repeated rows are rows of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.llm.common import WORD_PATTERN, as_struct, discard, materialize, mix, running, with_field

_WORD = re.compile(WORD_PATTERN)

WEIGHTS, RATIO, MOST, BLOCK_WORDS, SHARDS, CELL_ROWS, MOST_SOURCES, SEED = (3, 1, 2), 1.5, 2, 64, 64, 512, 100_000, 20240607


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, ratio: float = RATIO, most: float = MOST) -> list[float]:
    """Words to take from each source: shares by repeating weights of ratio * total, each at most `most` times its size,
    the excess shared again among the others until none is above."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    cap = most * np.array(sizes, float)
    out, open_, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), ratio * float(sum(sizes))
    while open_.any():
        share = left * w / w[open_].sum()
        over = open_ & (share > cap)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = cap[over]
        left -= cap[over].sum()
        open_ &= ~over
    return [float(min(t, c)) for t, c in zip(out, cap, strict=True)]


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n-1 for each key, by a Feistel network with cycle walking."""
    n = n.astype(np.uint64)
    half = np.ones(len(n), np.uint64)
    for b in range(1, 32):
        half = np.where(n > np.uint64(1) << np.uint64(2 * b), np.uint64(b + 1), half)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, k = half[todo], mask[todo]
        left, right = x[todo] >> h, x[todo] & k
        for r in range(rounds):
            left, right = right, left ^ (mix(right + key[todo] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r)) & k)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def shard_counts(slots: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): multinomial draws for equal shards, held to what each source still has."""
    rng, left, out = np.random.default_rng(seed), slots.astype(np.int64).copy(), np.zeros((shards, len(slots)), np.int64)
    for j in range(shards):
        room = int(left.sum()) // (shards - j)
        draw = np.minimum(rng.multinomial(room, left / left.sum()), left) if room else np.zeros(len(left), np.int64)
        while (short := room - int(draw.sum())) > 0:
            free = left - draw
            draw = np.minimum(draw + rng.multinomial(short, free / free.sum()), left)
        out[j], left = draw, left - draw
    return out


def row_key(docs: DataFrame) -> list[Column]:
    """h1, h2: two 64-bit hashes of a whole row, extra columns and all; a null counts by its place."""
    cols = [F.col(f"`{f.name}`") if "map<" not in f.dataType.simpleString() else F.to_json(F.struct(f"`{f.name}`")) for f in docs.schema]
    nulls = [F.col(f"`{c}`").isNull() for c in docs.columns]
    return [F.xxhash64(F.lit(i), *cols, *nulls).alias(h) for i, h in enumerate(("h1", "h2"))]


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, ratio: float = RATIO, most: int = MOST, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sources, takes).

    documents: doc_id, source, h1, h2 (the row's key), size, s (source number), start (place of its first word in its source).
    sources: s, source, source_size, target.
    takes: s, start, shard, slot, epoch, lo, hi: the words lo .. hi of a document that a slot takes."""
    spark, size = docs.sparkSession, block_words
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), *row_key(docs), words.alias("size")), "sized")
    stats = sized.groupBy("source").agg(F.sum("size").alias("w"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()  # one row a source
    if len(stats) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them first")
    stats.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["w"]) for r in stats]
    goal = targets(sizes, weights, ratio, most)
    sources = spark.createDataFrame([(i, r["source"], sizes[i], goal[i]) for i, r in enumerate(stats)], "s int, source string, source_size long, target double")
    rows = sum(r["n"] for r in stats)

    cells = max(1, -(-rows // CELL_ROWS))
    cell = F.pmod(F.xxhash64(F.lit(seed), "h1", "h2"), F.lit(cells)).cast("int")
    known = sized.join(F.broadcast(sources.select("s", F.col("source").alias("of"))), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("cell", cell)  # MOST_SOURCES rows at most
    order = Window.partitionBy("s", "cell").orderBy(F.xxhash64(F.lit(seed + 1), "h1", "h2"), "h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    inner = known.withColumn("inner", F.coalesce(F.sum("size").over(order), F.lit(0)))
    sums = running(known.groupBy("s", "cell").agg(F.sum("size").alias("w")), ["s"], "cell", "w", "base")
    placed = materialize(inner.join(sums, ["s", "cell"]).select("doc_id", "source", "h1", "h2", "size", "s", (F.col("base") + F.col("inner")).alias("start")), "placed")
    discard(sized)

    whole = np.array([round(g) for g in goal], np.int64)
    blocks = np.array([-(-w // size) for w in sizes], np.int64)
    tail = np.array([w - (b - 1) * size if b else 0 for w, b in zip(sizes, blocks.tolist(), strict=True)], np.int64)  # words of the last block
    key = mix(np.arange(len(sizes) * (most + 1), dtype=np.uint64) + np.uint64(seed)).reshape(len(sizes), most + 1)
    at_last = np.zeros((len(sizes), most), np.int64)  # the slot, in each epoch, that takes the last block
    slots, cut = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, n in enumerate(blocks.tolist()):
        if not n or not whole[i]:
            continue
        for e in range(most):
            at_last[i, e] = e * n + _preimage(n - 1, n, key[i, e])
        length = lambda t, i=i: t * size - sum((size - tail[i]) for e in range(most) if at_last[i, e] < t)
        t = int(whole[i] // size)
        while length(t) < whole[i]:
            t += 1
        slots[i], cut[i] = t, length(t) - whole[i]  # the last slot leaves out so many words
    draws = shard_counts(slots, shards, seed)
    seg_len = draws.reshape(-1)  # shard-major
    seg_end = np.cumsum(seg_len)
    seg_first = (np.cumsum(draws, axis=0) - draws).reshape(-1)  # slot of the source at which the segment begins
    total = int(slots.sum())

    def fill(batches):
        for batch in batches:
            p = batch.column(0).to_numpy()
            g = np.searchsorted(seg_end, p, side="right")
            shard, s = np.divmod(g, len(sizes))
            t = seg_first[g] + p - (seg_end[g] - seg_len[g])
            epoch, j = np.divmod(t, blocks[s])
            block = permuted(j, blocks[s], key[s, epoch])
            words = np.where(block == blocks[s] - 1, tail[s], size) - np.where(t == slots[s] - 1, cut[s], 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s.astype(np.int32), block, shard.astype(np.int32), t, epoch.astype(np.int32), words.astype(np.int64))], ["s", "block", "shard", "slot", "epoch", "words"])

    parts = max(1, min(-(-total // 200_000), 10_000))
    filled = spark.range(0, total, 1, parts).mapInArrow(fill, "s int, block long, shard int, slot long, epoch int, words long")
    lies = placed.where("size > 0").select("s", "start", "size", F.explode(F.expr(f"sequence(start div {size}, (start + size - 1) div {size})")).alias("block"))
    base = F.col("block") * size
    lo, hi = F.greatest("start", base), F.least(F.col("start") + F.col("size"), base + F.col("words"))
    takes = lies.join(filled, ["s", "block"]).where(lo < hi).select("s", "start", "shard", "slot", "epoch", (lo - F.col("start")).alias("lo"), (hi - F.col("start")).alias("hi"))
    return placed, sources, takes


def _preimage(value: int, n: int, key: np.uint64) -> int:
    """Where the permutation takes `value`: the inverse Feistel network, walked back."""
    half = 1
    while n > 1 << (2 * half):
        half += 1
    mask, x = np.uint64((1 << half) - 1), np.uint64(value)
    h = np.uint64(half)
    with np.errstate(over="ignore"):
        while True:
            left, right = x >> h, x & mask
            for r in reversed(range(4)):
                left, right = right ^ (mix(np.array([left + key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r)], np.uint64))[0] & mask), left
            x = (left << h) | right
            if x < n:
                return int(x)


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken): one row per document."""
    placed, sources, takes = mixed(docs, **options)
    words = takes.groupBy("s", "start").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    named = placed.withColumn("full", F.col("size") > 0)
    out = named.join(words.withColumn("full", F.lit(True)), ["s", "start", "full"], "left").join(sources.drop("source"), "s")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def remixed(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: docs' columns, one row for each time (epoch) that the mix takes from a document, with the
    words taken.  A document taken whole keeps its text as it is; otherwise the runs of words taken stand on lines of their own."""
    placed, _, takes = mixed(docs, **options)
    runs = takes.groupBy("s", "start", "epoch").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    keyed = placed.where("size > 0").join(runs, ["s", "start"]).select("h1", "h2", "size", "runs")
    h1, h2 = row_key(docs)
    texts = as_struct(docs, h1=h1, h2=h2).dropDuplicates(["h1", "h2"])

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                doc, out = part.column(0), []
                for text, size, runs in zip(doc.field("text").to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    merged: list[list[int]] = []
                    for r in runs:
                        if merged and merged[-1][1] == r["lo"]:
                            merged[-1][1] = r["hi"]
                        else:
                            merged.append([r["lo"], r["hi"]])
                    if merged != [[0, size]]:
                        spans = [m.span() for m in _WORD.finditer(text)]
                        text = "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in merged)
                    out.append(text)
                yield pa.RecordBatch.from_arrays([with_field(doc, "text", pa.array(out, pa.string()))], ["doc"])

    rows = texts.join(keyed, ["h1", "h2"]).select("doc", "size", "runs")
    return rows.mapInArrow(cut, rows.select("doc").schema).select("doc.*")

"""Language identification by bit-sliced Bloom filters over character n-grams.

One table of slots holds a bit per language; an n-gram's k slots, and-ed, give at once all languages whose filter holds it.
A text is decided by its popcounts: for each language the n-grams found, less those that its filter's fill rate
explains by chance (hits - n * fp) / (1 - fp).  A filter holds the n-grams that are typical of its language: at
least `floor` of the language's n-grams and `ratio` of the share that they have in any language, so that stray labels do not enter.

N-grams are trigrams of lower-cased letters with one mark for anything else at either side, hashed to `GRAM_BITS` bits;
counts are tables of at most 2**GRAM_BITS numbers per language, summed over all labelled rows.

At most MOST_LANGUAGES labels are learned; more raise an error (labels are then something else than languages).

Defined cases: null text, or no letter: `und`, score 0.  Without anything learned every text is `und`.  Rows with null id or label teach
nothing.  Ties go to the language first in order.  Repeated rows count as often as they come; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import discard, materialize, mix, slices, text_buffer

GRAM_BITS, PROBES, SLOTS_PER_GRAM, FLOOR, RATIO, UNKNOWN = 20, 3, 8, 2e-6, 0.15, "und"
#: Labels that filters are made for; tables of counts that a task holds before it sends them on; bytes of the filters.
MOST_LANGUAGES, TABLES, MOST_BYTES = 256, 16, 1 << 28


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for any other character."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(column: pa.Array, bits: int = GRAM_BITS):
    """(n-gram numbers, row of each, rows' first row) of a string column, slice by slice."""
    data, offsets = text_buffer(column)
    for lo, hi in slices(offsets, 1 << 19):
        raw = data[offsets[lo] : offsets[hi]]
        chars = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        ends = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets[lo : hi + 1] - offsets[lo]]
        low = _letters()[chars].astype(np.uint64)
        before, after = np.zeros_like(low), np.zeros_like(low)
        before[1:], after[:-1] = low[:-1], low[1:]
        full = np.flatnonzero(np.diff(ends))
        before[ends[:-1][full]] = 0
        after[ends[1:][full] - 1] = 0
        at = np.flatnonzero(low)
        code = mix((before[at] << np.uint64(42)) | (low[at] << np.uint64(21)) | after[at]) >> np.uint64(64 - bits)
        yield code.astype(np.int64), np.searchsorted(ends, at, side="right") - 1 + lo, lo, hi


def gram_counts(docs: DataFrame, text: Column, label: Column) -> DataFrame:
    """(lang, gram, n) over all rows whose label is not null."""

    def sent(sums):
        for name in list(sums):
            x = sums.pop(name)
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(x[at])], ["lang", "gram", "n"])

    def work(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, codes = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str), return_inverse=True)
            for g, row, _, _ in grams(batch.column(0)):
                lang = codes[row]
                for i in np.unique(lang):
                    have = sums.setdefault(str(names[i]), np.zeros(1 << GRAM_BITS, np.int64))
                    have += np.bincount(g[lang == i], minlength=1 << GRAM_BITS)
                    if len(sums) > TABLES:
                        yield from sent(sums)
        yield from sent(sums)

    each = docs.where(label.isNotNull() & text.isNotNull()).select(text.alias("text"), label.cast("string").alias("label")).mapInArrow(work, "lang string, gram long, n long")
    return each.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """Bit-sliced Bloom filters: slots[word][slot] has bit l for language 64 * word + l."""

    def __init__(self, langs: list[str], held: list[np.ndarray]):
        self.langs = langs
        most = max([len(x) for x in held], default=0)
        self.bits = max(10, int(max(1, most * SLOTS_PER_GRAM) - 1).bit_length())
        self.slots = np.zeros((max(1, -(-len(langs) // 64)), 1 << self.bits), np.uint64)
        for i, g in enumerate(held):
            for s in self.probes(g):
                self.slots[i // 64, s] |= np.uint64(1) << np.uint64(i % 64)
        self.fp = np.array([float(((self.slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) ** PROBES for i in range(len(langs))])

    def probes(self, g: np.ndarray):
        for k in range(PROBES):
            yield (mix(g.astype(np.uint64) + np.uint64((k + 1) << 32)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def masks(self, g: np.ndarray) -> list[np.ndarray]:
        """All languages that hold each n-gram, as words of 64 bits."""
        probes = list(self.probes(g))
        return [functools.reduce(np.bitwise_and, (word[s] for s in probes)) for word in self.slots]

    def decide(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        lang, score = np.full(len(column), -1), np.zeros(len(column))
        if self.langs:
            for g, row, lo, hi in grams(column):
                if not len(g):
                    continue
                first = np.flatnonzero(np.diff(row, prepend=-1))
                n = np.diff(np.append(first, len(row)))
                masks = self.masks(g)
                net = np.empty((len(self.langs), len(first)))
                for i, fp in enumerate(self.fp):
                    hits = np.add.reduceat(((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64), first)
                    net[i] = np.clip((hits - n * fp) / max(1 - fp, 1e-9), 0, None)
                best = np.argmax(net, axis=0)
                lang[row[first]] = best
                score[row[first]] = np.clip(net[best, np.arange(len(first))] / n, 0, 1)
        return [self.langs[i] if i >= 0 else UNKNOWN for i in lang], score


def learn(docs: DataFrame, text: Column, label: Column) -> Filters:
    """Filters from labelled rows.  The driver sees at most 2**GRAM_BITS n-grams a language."""
    counts = materialize(gram_counts(docs, text, label), "grams")
    try:
        sums = counts.groupBy("lang").agg(F.sum("n").alias("all"))
        if (labels := len(sums.limit(MOST_LANGUAGES + 1).collect())) > MOST_LANGUAGES:
            raise ValueError(f"{labels} labels or more; filters are made for at most {MOST_LANGUAGES} languages")
        share = counts.join(sums, "lang").select("lang", "gram", (F.col("n") / F.col("all")).alias("p"))
        top = share.groupBy("gram").agg(F.max("p").alias("top"))
        got = share.join(top, "gram").where((F.col("p") >= FLOOR) & (F.col("p") >= RATIO * F.col("top"))).select("lang", "gram").toArrow().to_pandas()
    finally:
        discard(counts)
    langs = sorted(got["lang"].unique())
    return Filters(langs, [got["gram"][got["lang"] == x].to_numpy() for x in langs])


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame, filters: Filters, keep: list[str], text_col: str = "text") -> DataFrame:
    """(doc, lang_pred, score): doc holds the columns `keep` as a struct, so no name clashes."""
    if filters.slots.nbytes > MOST_BYTES:
        raise ValueError(f"filters of {filters.slots.nbytes} bytes are too large to send to every worker")
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # at most MOST_BYTES

    def work(batches):
        for batch in (b.slice(lo, 1024) for b in batches for lo in range(0, b.num_rows, 1024)):
            doc = batch.column(0)
            lang, score = sent.value.decide(batch.column(1) if batch.num_columns > 1 else doc.field(text_col))
            yield pa.RecordBatch.from_arrays([doc, pa.array(lang, pa.string()), pa.array(score)], ["doc", "lang_pred", "score"])

    rows = docs.select(F.struct(*(f"`{c}`" for c in keep)).alias("doc"), *([] if text_col in keep else [F.col(text_col).alias("text")]))
    schema = rows.select("doc").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(work, schema)


def language_id(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc, lang_pred, score): learn from labelled rows that are not held out, then predict every row; doc holds the columns `keep`."""
    learnable = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col))
    return identified(docs, learn(learnable, F.col(text_col), F.col(lang_col)), keep, text_col)

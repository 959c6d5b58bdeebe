"""Suffix-array dedup by a run-length index: mark every byte under a string of `length` units that also starts elsewhere.

Rules.  A rule names a unit and a length: BYTES are 400 bytes as they stand; WORDS are 51 words, each with one space behind it
whatever white space a text has there, so that a passage of over 50 words is found where it is laid out anew, too.

The index.  A bucket's windows, parted by a byte that UTF-8 never uses, get a suffix array; its Burrows-Wheeler
transform is kept as runs with the suffix positions at both ends of each run.  These samples alone stream the
matching statistics of the windows against all others: at a run's first suffix the longest common prefix with the suffix
before it is measured, and from there on it shrinks by one per byte until the next sample (the same from run ends to the
suffix after).  In repetitive windows there are few runs.  Starts whose statistic reaches their `length` units are marked; samples
whose prefix is shorter than the shortest such string mark none and are left out by one comparison.

Which windows meet.  Every start of a `length`-unit string names the leftmost least fingerprint of the `gram`-unit strings
inside it, so equal strings name equal fingerprints (winnowing); starts that follow each other and name the same place form
one window.  Windows are grouped by fingerprint; only groups with two windows or more can hold a repeat, and windows
of equal bytes collapse to one that counts as repeated throughout.  So an exact or long copy costs one window however often it
occurs.  Groups are spread over buckets of about `bucket_bytes`.  The windows of a group with more than `crowd` different ones
are first parted, PARTS times each, by the core that all strings of a part share, again and again until no group is larger; at the
last a part is one string.  So no task gathers a frequent fingerprint.

Positions never leave a text; whole copies of a text are settled by their digests.  Long texts are surveyed in parts of
PART_BYTES that overlap by a string, so that vectors stay small.  Comparisons outside the index are of 64-bit fingerprints
and of MD5 digests.

Defined cases: null text is empty; texts shorter than `length` lose nothing; repeated rows are copies of each
other, so they are repeats; null ids are allowed; an empty table gives an empty result; extra columns are ignored, and `cleaned`
keeps them, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import Prefix, as_struct, discard, materialize, mix, prefix_hash, slices, span_hash, text_buffer, with_field, word_bounds

#: Rules: (kind, length, gram), in units of the kind.
BYTES, WORDS = ("bytes", 400, 128), ("words", 51, 20)
BUCKET_BYTES, TASK_BUCKETS, CROWD, PARTS, PLACE_BITS, PART_BYTES = 1_000_000, 4, 1000, 5, 26, 1 << 23
#: Rows are surveyed so many bytes at a time: vectors of 8 bytes for each stay in a core's cache.
SLICE_BYTES = 1 << 16
#: No part of a key holds more than this share of the rows that a join spreads; so at most as many keys are broadcast.
SPREAD = 1000
SEPARATOR = 255


# ---- the index ----------------------------------------------------------------------------------


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array by prefix tripling from 7-byte keys; each round sorts what is still tied only."""
    n = len(t)
    symbols = np.zeros(n + 6, np.uint64)
    symbols[:n] = t
    symbols[:n] += np.uint64(1)  # 0 stands past the end
    key = symbols[:n].copy()
    for i in range(1, 7):
        key <<= np.uint64(9)
        key |= symbols[i : i + n]
    sa = np.argsort(key)
    key = key[sa]
    rank = np.zeros(n + 1, np.uint32)
    at, who = np.arange(n), sa  # places that are tied, and the suffixes there
    k, parts = 7, 3 if n < (1 << 21) - 1 else 2  # as many ranks as fit 63 bits
    shift = np.uint64(63 // parts)
    while True:
        head = np.ones(len(at) + 1, bool)
        head[1:-1] = key[1:] != key[:-1]
        tie = at.astype(np.uint32)
        tie += np.uint32(1)
        tie *= head[:-1]
        np.maximum.accumulate(tie, out=tie)
        rank[who] = tie
        tied = np.flatnonzero(~(head[:-1] & head[1:]))
        if not len(tied):
            return sa
        at, who, key = at[tied], who[tied], tie[tied].astype(np.uint64)
        for j in range(1, parts):
            place = who + j * k
            np.minimum(place, n, out=place)
            key <<= shift
            key |= rank[place]
        order = np.argsort(key)
        who, key = who[order], key[order]
        sa[at] = who
        k *= parts


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of t with the suffix positions at run heads and run ends."""

    def __init__(self, t: np.ndarray):
        self.t, sa = t, suffix_array(t)
        bwt = t[sa - 1]  # the suffix at 0 takes the last byte, as on a circle
        head = np.ones(len(t) + 1, bool)
        head[1:-1] = bwt[1:] != bwt[:-1]
        if len(t):
            origin = int(np.argmin(sa))
            head[origin : origin + 2] = True
        self.symbols = bwt[head[:-1]]
        edge = np.flatnonzero(head[1:-1]) + 1
        self.heads, self.before = sa[edge], sa[edge - 1]  # head of each run but the first, and the end of the run before

    def _common(self, i: np.ndarray, j: np.ndarray, prefix: Prefix, least: int) -> np.ndarray:
        """Longest common prefixes, of `least` at the least, of suffix pairs, by binary search over fingerprints."""
        lo, hi = np.full(len(i), least), len(self.t) - np.maximum(i, j)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_] + 1) // 2
            a, b = i[open_], j[open_]
            same = span_hash(prefix, a, a + mid) == span_hash(prefix, b, b + mid)
            lo[open_] = np.where(same, mid, lo[open_])
            hi[open_] = np.where(same, hi[open_], mid - 1)

    def statistics(self, least: int = 1) -> np.ndarray:
        """For every position the longest string starting there that also starts at another position, 0 if it is shorter than `least`.

        From a sample on a statistic only shrinks, so samples below `least` need no measure: one comparison leaves them out."""
        n = len(self.t)
        prefix = prefix_hash(self.t)
        i, j = self.heads, self.before
        for size in (min(least, 8), least):  # most pairs part within a word
            fits = np.flatnonzero(np.maximum(i, j) + size <= n)
            i, j = i[fits], j[fits]
            same = span_hash(prefix, i, i + size) == span_hash(prefix, j, j + size)
            i, j = i[same], j[same]
        common = self._common(i, j, prefix, least)
        reach = np.zeros(n, np.int64)
        reach[i] = i + common
        reach[j] = np.maximum(reach[j], j + common)
        out = np.maximum.accumulate(reach) - np.arange(n)
        out[out < least] = 0
        return out


def repeats_in(windows: list[tuple], kind: str, length: int) -> list[tuple]:
    """windows: (h1, h2, lo, hi, bytes of the units lo to hi + length, known).  Runs (h1, h2, first, last) of repeated starts of
    windows that aren't known as repeated already."""
    windows.sort(key=lambda w: w[:3])
    lead = b" " if kind == "words" else b""  # with it, a match begins where a word does
    parts, spans, size, text, last_lo, last_end, last_at, last_bounds = [], [], 0, None, 0, 0, 0, None
    for h1, h2, lo, hi, raw, known in windows:
        bounds = _bounds(raw, kind)
        if text == (h1, h2) and lo < last_end:  # goes on where the window before does: one text
            at = last_at + int(last_bounds[lo - last_lo])
            more = raw[int(bounds[last_end - lo]) :] if hi + length > last_end else b""
        else:
            if parts:
                parts.append(bytes([SEPARATOR]))
                size += 1
            at, more, last_end = size + len(lead), lead + raw, 0
        parts.append(more)
        size += len(more)
        spans.append((at + bounds, h1, h2, lo, hi, known))
        if hi + length > last_end:
            text, last_lo, last_end, last_at, last_bounds = (h1, h2), lo, hi + length, at, bounds
    if len(spans) < 2:
        return []
    spans = [s for s in spans if not s[-1]]
    needs = [bounds[length : length + hi - lo + 1] - bounds[: hi - lo + 1] + len(lead) for bounds, _, _, lo, hi, _ in spans]
    if not spans:
        return []
    common = RunIndex(np.frombuffer(b"".join(parts), np.uint8)).statistics(min(int(x.min()) for x in needs))
    out = []
    for (bounds, h1, h2, lo, hi, _), need in zip(spans, needs, strict=True):
        repeated = common[bounds[: len(need)] - len(lead)] >= need
        if repeated.any():
            edge = np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]]))
            out += [(h1, h2, lo + a, lo + b - 1) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
    return out


# ---- windows ------------------------------------------------------------------------------------


def _bounds(raw: bytes, kind: str) -> np.ndarray:
    """Where the units of a window begin, and its end."""
    if kind == "bytes":
        return np.arange(len(raw) + 1)
    return np.append(0, np.flatnonzero(np.frombuffer(raw, np.uint8) == 32) + 1)


def units(data: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The text that a rule compares, and where its units begin, with its end."""
    if kind == "bytes":
        return data, np.arange(len(data) + 1)
    closed = np.append(data, np.uint8(32))
    starts, ends = word_bounds(closed)
    depth = np.zeros(len(closed) + 1, np.int8)
    depth[starts] += 1
    depth[ends + 1] -= 1  # a word and one byte behind it
    text = closed[np.cumsum(depth[:-1]) > 0]
    bounds = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    text[bounds[1:] - 1] = 32
    return text, bounds


def windows_of(text: np.ndarray, bounds: np.ndarray, first_unit: np.ndarray, length: int, gram: int):
    """(row, lo, hi, place named, fingerprint, bytes' fingerprint) of the windows of rows whose units stand one after another."""
    n, wide = len(bounds) - 1, length - gram + 1
    if n < length:
        return [np.zeros(0, np.int64)] * 6
    prefix = prefix_hash(text)
    at = np.arange(n - gram + 1)
    mark = span_hash(prefix, bounds[: n - gram + 1], bounds[gram:])
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (mark & ~low) | at.astype(np.uint64)
    s = 1
    while 2 * s <= wide:
        least = np.minimum(least[:-s], least[s:])
        s *= 2
    if wide > s:
        least = np.minimum(least[: -(wide - s)], least[wide - s :])
    starts = at[: len(least)]
    row = np.searchsorted(first_unit, starts, side="right") - 1
    fine = starts + length <= first_unit[row + 1]
    place = (least & low).astype(np.int64)
    first = fine.copy()
    first[1:] &= (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | ~fine[:-1]
    lo = np.flatnonzero(first)
    after = fine.copy()
    after[:-1] &= (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | ~fine[1:]
    hi = np.flatnonzero(after)
    base = first_unit[row[lo]]
    return row[lo], lo - base, hi - base, place[lo] - base, mark[place[lo]].view(np.int64), span_hash(prefix, bounds[lo], bounds[hi + length]).view(np.int64)


def survey_windows(data: np.ndarray, ends: np.ndarray, rules: tuple):
    """(row, kind's number, lo, hi, p, m, w) of all rules, ordered by row, and the units of every row and rule."""
    found, counts = [], []
    for k, (kind, length, gram) in enumerate(rules):
        salt = mix(np.array([k], np.uint64))[0]  # rules never meet
        apart, first = data, ends
        if kind == "words":  # words don't run on from row to row
            sizes = np.diff(ends)
            apart = np.full(len(data) + len(sizes), 32, np.uint8)
            apart[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data
            first = np.searchsorted(word_bounds(apart)[0], np.append(ends[:-1] + np.arange(len(sizes)), len(apart)))
        text, bounds = units(apart, kind)
        counts.append(np.diff(first))
        step = PART_BYTES if len(first) == 2 else max(1, len(bounds))
        for lo in range(0, max(1, len(bounds) - 1), step):  # a long text in parts
            hi = min(len(bounds) - 1, lo + step + length - 1)
            here = first if len(first) > 2 else np.array([0, hi - lo])
            row, a, b, p, m, w = windows_of(text[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], here, length, gram)
            shift = lo if len(first) == 2 else 0
            found.append((row, np.full(len(row), k), a + shift, b + shift, p + shift, (m.view(np.uint64) ^ salt).view(np.int64), w))
    cols = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.argsort(cols[0], kind="stable")
    return [c[order] for c in cols], counts


def survey_slices(data: np.ndarray, ends: np.ndarray, rules: tuple):
    """The same as survey_windows, from SLICE_BYTES of rows at a time."""
    found, counts = [], []
    for a, b in slices(ends, SLICE_BYTES):
        (row, *cols), n = survey_windows(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], rules)
        found.append((row + a, *cols))
        counts.append(n)
    return [np.concatenate(x) for x in zip(*found, strict=True)], [np.concatenate(x) for x in zip(*counts, strict=True)]


def _digest(raw: bytes) -> tuple[int, int]:
    d = hashlib.md5(raw, usedforsecurity=False).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def digest_columns(text: Column) -> tuple[Column, Column]:
    """The same two numbers in the JVM."""
    d = F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    return tuple(F.conv(F.substring(d, i, 16), 16, -10).cast("long") for i in (1, 17))  # type: ignore[return-value]


def surveyed(docs: DataFrame, rules: tuple) -> DataFrame:
    """(doc_id, h1, h2, n_bytes, n_units of each rule, sha, windows) of every row of docs (doc_id, text)."""

    def work(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets, 1 << 19):
                part, ends = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                (row, *cols), counts = survey_slices(part, ends, rules)
                first = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                h1, h2, sha = [], [], []
                for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    raw = part[i:j].tobytes()
                    x, y = _digest(raw)
                    h1.append(x)
                    h2.append(y)
                    sha.append(hashlib.sha256(raw).hexdigest())
                items = pa.StructArray.from_arrays([pa.array(x.astype(t)) for x, t in zip(cols, (np.int32, *[np.int64] * 5), strict=True)], ["k", "lo", "hi", "p", "m", "w"])
                each = pa.ListArray.from_arrays(pa.array(np.arange(0, len(counts) * (b - a) + 1, len(counts), dtype=np.int32)), pa.array(np.array(counts, np.int64).T.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(np.diff(ends)), each, pa.array(sha), pa.ListArray.from_arrays(pa.array(first), items)], ["doc_id", "h1", "h2", "n_bytes", "n_units", "sha", "windows"])

    return docs.mapInArrow(work, "doc_id long, h1 long, h2 long, n_bytes long, n_units array<long>, sha string, windows array<struct<k:int,lo:long,hi:long,p:long,m:long,w:long>>")


def spread_join(rows: DataFrame, keys: DataFrame, on: str, by: str) -> DataFrame:
    """rows (on, by, ...) joined with keys (on, its number of rows, ...); a key with many rows is parted by the hash of `by`.

    The parts of a key follow from its count.  Only keys of two parts or more are broadcast: at most SPREAD of them exist."""
    total = keys.agg(F.sum("rows")).first()[0] or 1
    parts = F.ceil(F.col("rows") * F.lit(SPREAD) / F.lit(total)).cast("int")
    hot = F.broadcast(keys.where(parts > 1).select(on, parts.alias("parts")))
    dealt = rows.join(hot, on, "left").withColumn("part", F.pmod(F.xxhash64(by, F.lit(11)), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copied = keys.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return dealt.join(copied, [on, "part"]).drop("part")


def parted(windows: DataFrame, rules: tuple, widths: list[int]) -> DataFrame:
    """Windows cut into those of starts that stand at most `width` units apart, counted back from the place they name.

    All strings at such starts hold one core, from the last start to the end of the first one's string, so strings can be equal
    only where cores are: m becomes the core's fingerprint."""

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(lo, 256).to_pylist():
                    kind, length, _ = rules[r["k"]]
                    width, raw, first = widths[r["k"]], r["raw"], r["lo"]
                    bounds = _bounds(raw, kind)
                    prefix = prefix_hash(np.frombuffer(raw, np.uint8))
                    j = np.arange((r["p"] - r["hi"]) // width, (r["p"] - first) // width + 1)
                    last = r["p"] - j * width  # the starts of part j are last - width + 1 .. last
                    a, b = np.maximum(last - width + 1, first), np.minimum(last, r["hi"])
                    core = span_hash(prefix, bounds[last - first], bounds[last - width + 1 + length - first])
                    m = mix(core ^ mix(np.array([r["m"]], np.int64).view(np.uint64) + j.astype(np.uint64))).view(np.int64)
                    w = span_hash(prefix, bounds[a - first], bounds[b + length - first]).view(np.int64)
                    cut = [raw[x:y] for x, y in zip(bounds[a - first].tolist(), bounds[b + length - first].tolist(), strict=True)]
                    out += [(r["h1"], r["h2"], r["k"], x, y, r["p"], z, v, r["known"], c) for x, y, z, v, c in zip(a.tolist(), b.tolist(), m.tolist(), w.tolist(), cut, strict=True)]
                types = [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["h1", "h2", "k", "lo", "hi", "p", "m", "w", "known", "raw"])

    parts = windows.select("h1", "h2", "k", "lo", "hi", "p", "m", "known", "raw").mapInArrow(work, "h1 long, h2 long, k int, lo long, hi long, p long, m long, w long, known boolean, raw binary")
    return parts.withColumn("id", F.xxhash64("h1", "h2", "lo"))


def repeated_starts(docs: DataFrame, rules: tuple, crowd: int = CROWD, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> (survey, marks).

    survey: doc_id, h1, h2, n_bytes, n_units, sha of each row, and whether the text has copies.
    marks: h1, h2, runs (array of k, lo, hi): the repeated starts, in units of rule k, of texts without copies."""
    survey = materialize(surveyed(docs, rules), "survey")
    texts = survey.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    each = survey.select("doc_id", "h1", "h2", F.explode("windows").alias("x")).select("doc_id", "h1", "h2", "x.*").withColumn("id", F.xxhash64("h1", "h2", "lo"))
    shared = materialize(each.groupBy("m").agg(F.min("id").alias("i"), F.max("id").alias("j"), F.count("*").alias("rows")).where("i <> j").select("m", "rows"), "shared")
    row = F.xxhash64("doc_id", "id").alias("row")  # copies of a text differ by doc_id
    live = materialize(spread_join(each.select("h1", "h2", "k", "lo", "hi", "p", "m", "w", "id", row), shared, "m", "row").drop("row", "rows"), "live")
    kinds = materialize(live.groupBy("m", "w").agg(F.min("id").alias("i"), F.max("id").alias("j")), "kinds")
    crowds = materialize(kinds.groupBy("m").agg(F.count("*").alias("rows")), "crowds")
    counted = spread_join(kinds, crowds, "m", "w").select("m", "w", "i", (F.col("i") != F.col("j")).alias("known"), F.col("rows").alias("kinds"))
    told = materialize(live.join(counted, ["m", "w"]), "told")
    discard(shared, live, kinds, crowds)
    todo = told.where("id = i and kinds > 1").dropDuplicates(["m", "id"]).groupBy("h1", "h2").agg(F.collect_list(F.struct("k", "lo", "hi", "p", "m", "known", (F.col("kinds") > crowd).alias("crowded"))).alias("need"))
    need = todo.join(texts.drop("copies"), ["h1", "h2"]).select(F.col("doc_id").alias("rep"), "h1", "h2", "need")
    names = [kind for kind, _, _ in rules]
    lengths = [length for _, length, _ in rules]

    def cut_out(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                out = []
                for text, h1, h2, need in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    raw = np.frombuffer((text or "").encode(), np.uint8)
                    of = {k: units(raw, names[k]) for k in {w["k"] for w in need}}
                    for w in need:
                        chars, bounds = of[w["k"]]
                        out.append((h1, h2, w["k"], w["lo"], w["hi"], w["p"], w["m"], w["known"], w["crowded"], chars[bounds[w["lo"]] : bounds[w["hi"] + lengths[w["k"]]]].tobytes()))
                types = [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 4 + [pa.bool_()] * 2 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["h1", "h2", "k", "lo", "hi", "p", "m", "known", "crowded", "raw"])

    a, b = digest_columns(F.col("text"))
    named = docs.select("doc_id", "text", a.alias("d1"), b.alias("d2"))  # the digests part the rows of one id, null ids too
    joined = named.join(need, named["doc_id"].eqNullSafe(need["rep"]) & (F.col("d1") == F.col("h1")) & (F.col("d2") == F.col("h2"))).select("text", "h1", "h2", "need")
    cut = materialize(joined.mapInArrow(cut_out, "h1 long, h2 long, k int, lo long, hi long, p long, m long, known boolean, crowded boolean, raw binary"), "windows")

    few, pending, twins = [cut.where("not crowded")], cut.where("crowded"), []
    widths, made = [length - gram + 1 for _, length, gram in rules], []
    while not pending.isEmpty():  # at width 1 equal strings are all that is left together
        widths = [-(-x // PARTS) for x in widths]
        parts = materialize(parted(pending, rules, widths), "parts")
        kinds = materialize(parts.groupBy("m", "w").agg(F.min("id").alias("i"), F.max("id").alias("j")), "kinds")
        crowds = materialize(kinds.groupBy("m").agg(F.count("*").alias("rows")), "crowds")
        counted = spread_join(kinds, crowds, "m", "w").select("m", "w", "i", (F.col("i") != F.col("j")).alias("twin"), F.col("rows").alias("kinds"))
        found = materialize(parts.join(counted, ["m", "w"]).where("twin or kinds > 1").select("h1", "h2", "k", "lo", "hi", "p", "m", (F.col("known") | F.col("twin")).alias("known"), F.expr("twin and not known").alias("new"), F.expr("id = i and kinds > 1").alias("rep"), (F.col("kinds") > crowd).alias("crowded"), F.when(F.expr("id = i and kinds > 1"), F.col("raw")).alias("raw")), "found")
        discard(parts, kinds, crowds)
        made.append(found)
        twins.append(found.where("new").select("k", "h1", "h2", "lo", "hi"))
        few.append(found.where("rep and not crowded").select(*cut.columns))
        pending = found.where("rep and crowded").select(*cut.columns)
    cuts = functools.reduce(DataFrame.unionByName, few)
    size = cuts.agg(F.sum(F.length("raw"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))

    def search(t: pa.Table) -> pa.Table:
        rows = list({r[:4]: r for r in zip(*(t.column(c).to_pylist() for c in ("k", "h1", "h2", "lo", "hi", "raw", "known")), strict=True)}.values())
        found = [(k, *r) for k in range(len(names)) for r in repeats_in([r[1:] for r in rows if r[0] == k], names[k], lengths[k])]
        return pa.table([pa.array([r[i] for r in found], pa.int32() if not i else pa.int64()) for i in range(5)], ["k", "h1", "h2", "lo", "hi"])

    placed = cuts.withColumn("bucket", F.pmod(F.xxhash64("m"), F.lit(buckets)))
    placed = placed.withColumn("task", F.expr(f"cast(bucket div {TASK_BUCKETS} as int)")).repartitionById(-(-buckets // TASK_BUCKETS), "task")  # a task's work stays the same at every size
    indexed = placed.groupBy("task", "bucket").applyInArrow(search, "k int, h1 long, h2 long, lo long, hi long")

    known = told.where("known").select("k", "h1", "h2", "lo", "hi")
    whole = texts.where("copies > 1").select("h1", "h2")
    runs = functools.reduce(DataFrame.unionByName, [known, indexed, *twins]).join(whole, ["h1", "h2"], "left_anti")
    marks = materialize(runs.groupBy("h1", "h2").agg(F.sort_array(F.collect_set(F.struct("k", "lo", "hi"))).alias("runs")), "marks")
    discard(told, cut, *made)
    return survey.drop("windows").join(whole.withColumn("copied", F.lit(True)), ["h1", "h2"], "left").withColumn("copied", F.coalesce("copied", F.lit(False))), marks


def kept_bytes(raw: bytes, runs, rules: tuple) -> tuple[bytes, int, int]:
    """What is left of raw without the strings at the repeated starts; bytes and maximal runs removed."""
    step, ends = np.zeros(len(raw) + 1, np.int64), None
    for r in runs:
        kind, length, _ = rules[r["k"]]
        lo, hi = r["lo"], r["hi"] + length
        if kind == "words":
            if ends is None:
                starts, ends = word_bounds(np.frombuffer(raw, np.uint8))
            lo, hi = starts[lo], ends[hi - 1]
        step[lo] += 1
        step[hi] -= 1
    gone = np.cumsum(step[:-1]) > 0
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(raw) else 0
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def _cut_rows(rows: DataFrame, rules: tuple, more: list[str]) -> DataFrame:
    """rows (doc_id, text, runs, more) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, more; more are numbers."""

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, out = batch.slice(lo, 256), []
                for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    kept, removed, spans = kept_bytes(raw, runs, rules)
                    out.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
                cols = [pa.array([x[i] for x in out], t) for i, t in enumerate([pa.int64()] * 3 + [pa.string()])]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, *(part.column(c) for c in more)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *more])

    return rows.select("doc_id", "text", "runs", *more).mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + "".join(f", {c} long" for c in more))


def _covered(runs: Column, length: int) -> Column:
    """Units under the strings at the starts of runs, which are in order."""
    begin = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda s, r: F.struct(F.greatest(s["end"], r["hi"] + length).alias("end"), (s["n"] + F.greatest(r["hi"] + length - F.greatest(s["end"], r["lo"]), F.lit(0))).alias("n"))
    return F.aggregate(runs, begin, step)["n"]


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: tuple = BYTES, counted: tuple = (), **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): one row per document, without the strings that `rule` finds.

    counted: rules of which the units found are only counted, in one more column each, n_repeated_<kind>."""
    rules = (rule, *counted)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    survey, marks = repeated_starts(base, rules, **options)
    rows = survey.join(marks, ["h1", "h2"], "left")
    of = lambda k: F.filter("runs", lambda r: r["k"] == k)
    more = [f"n_repeated_{kind}" for kind, _, _ in counted]
    extra = []
    for k, (_, length, _) in enumerate(counted, 1):
        all_ = F.when(F.col("n_units")[k] >= length, F.col("n_units")[k]).otherwise(0)
        extra.append(F.when(F.col("copied"), all_).when(F.col("runs").isNotNull(), _covered(of(k), length)).otherwise(0).cast("long").alias(more[k - 1]))
    gone = F.col("copied") & (F.col("n_bytes") >= rule[1])
    some = F.col("runs").isNotNull() & (F.size(of(0)) > 0)
    rows = materialize(rows.select("doc_id", "h1", "h2", "n_bytes", "sha", gone.alias("gone"), some.alias("some"), F.when(some, of(0)).alias("runs"), *extra), "rows")
    easy = rows.where("not some").select(
        "doc_id", "n_bytes", F.when(F.col("gone"), F.col("n_bytes")).otherwise(0).alias("n_removed"), F.col("gone").cast("long").alias("n_spans"), F.when(F.col("gone"), F.sha2(F.lit(b""), 256)).otherwise(F.col("sha")).alias("kept_sha256"), *more
    )
    a, b = digest_columns(F.col("text"))
    texts = base.select("doc_id", "text", a.alias("h1"), b.alias("h2")).join(rows.where("some").select("h1", "h2", "runs", *more), ["h1", "h2"])  # texts without copies
    return easy.unionByName(_cut_rows(texts, rules, more))


def cleaned(docs: DataFrame, rules: tuple = (BYTES, WORDS), **options) -> DataFrame:
    """docs (doc_id, text, ...) with the strings that any of the rules finds taken out of text.  A row that loses all but white
    space goes; one that had no more before stays."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey, marks = repeated_starts(base, rules, **options)
    all_gone = F.lit(False)
    for k, (_, length, _) in enumerate(rules):
        all_gone = all_gone | (F.col("n_units")[k] >= length)
    whole = survey.where(F.col("copied") & all_gone).select("h1", "h2").distinct()
    a, b = digest_columns(F.col("text"))
    rows = as_struct(docs, h1=a, h2=b).join(whole, ["h1", "h2"], "left_anti").join(marks, ["h1", "h2"], "left").select("doc", "runs")

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                doc, runs = batch.column(0).slice(lo, 256), batch.column(1).slice(lo, 256).to_pylist()
                texts, sound, out = doc.field("text").to_pylist(), [], []
                for t, r in zip(texts, runs, strict=True):
                    kept = t if r is None else kept_bytes(t.encode(), r, rules)[0].decode("utf-8", "ignore")
                    sound.append(r is None or bool(kept.strip()))
                    out.append(kept)
                yield pa.RecordBatch.from_arrays([with_field(doc, "text", pa.array(out, pa.string())).filter(pa.array(sound, pa.bool_()))], ["doc"])

    return rows.mapInArrow(work, rows.select("doc").schema).select("doc.*")

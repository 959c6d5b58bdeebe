"""MinHash near-duplicates: bottom-k sketches of one hash function, inverted lists, exact verification.

1. Each document's distinct word shingles become 64-bit values; its sketch is the k smallest.  Documents of equal sets
   collapse into one class first, so copies cost one row each from then on.
2. Inverted lists of retained values generate overlaps.  Two sets of similarity 0.75 share at least m of their k retained
   values, so it is enough to list each sketch's k - m + 1 rarest: what a common passage adds to many documents stays
   out of the lists.
3. First each class meets one partner only, the head (least id) of the lists that it shares most; the exact check of these
   forms components.  Then lists that still hold several components give the pairs across components; the union-sketch estimate
   (shared values among the k least of both sketches) filters these, and the exact Jaccard of full sets decides.
   Pairs inside a component are never made, nor all pairs of a list: short lists are joined, long ones compared tile by
   tile with the full sets at hand, in bounded memory, and a tile gives out a spanning forest of its links only.
   Long lists of one head hold much the same members, so their union is one block and a pair is compared once for all of
   them.  A component of more than a tile has tiles of its own in a block, which never meet each other: the rows made for it
   grow as its members, and with the square only of those that no component so large has taken up.

For sets of up to k values candidates are complete.  For larger ones a link of similarity 0.75 exactly shares fewer than m
retained values with probability below 1e-7, and less the more similar the two are.  No list and no member of one is left
out, however long.  Confirmed links are exact (sets are compared as 64-bit fingerprints of shingles).

Defined cases: no words or null text: no shingles, linked with nothing.  Fewer words than a shingle: one shingle of all.
A null id takes part in nothing: component null, kept true.  Repeated rows are returned as often as they come, with equal results.
Rows of one id are one document, whatever their texts: they share a component, while n_shingles is the row's own.  Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import ascii_lower, discard, materialize, mix, prefix_hash, slices, span_hash, text_buffer, word_bounds
from gridspark.llm.components import components

SHINGLE_WORDS, SKETCH, LEAST_SHARED, PERCENT = 5, 64, 28, 75
#: Lists up to this length are paired by a join; longer ones in tiles of TILE members and TILE_VALUES values.
SHORT_LIST, TILE, TILE_VALUES = 16, 768, 400_000
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct shingle values (as signed 64-bit)."""
    ended = pc.binary_join_element_wise(column.cast(pa.large_binary()).fill_null(b""), pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    data, offsets = text_buffer(ended)
    for lo, hi in slices(offsets, 1 << 19):
        part = ascii_lower(data[offsets[lo] : offsets[hi]])
        starts, ends = word_bounds(part)
        words = span_hash(prefix_hash(part), starts, ends)
        first = np.searchsorted(starts, offsets[lo : hi + 1] - offsets[lo])
        total = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for j in range(size):
            total = total * _STEP + words[j : j + len(total)]
        total = mix(total)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(total[a : b - size + 1].view(np.int64))
            elif b > a:
                value = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for w in words[a:b]:
                        value = value * _STEP + w
                yield mix(np.array([value])).view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def sketched(docs: DataFrame, id_col: str, text_col: str, size: int, k: int) -> DataFrame:
    """(doc_id, n, d1, d2, sketch) of every document."""

    def work(batches):
        for part in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
            n, d1, d2, sketch = [], [], [], []
            for s in shingle_sets(part.column(1), size):
                h = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                n.append(len(s))
                d1.append(h[0])
                d2.append(h[1])
                sketch.append(s[:k].copy())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), _lists(sketch)], ["doc_id", "n", "d1", "d2", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, n long, d1 long, d2 long, sketch array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, vals) of documents (doc_id, text)."""

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(list(shingle_sets(part.column(1), size)))], ["doc_id", "vals"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, vals array<long>")


def exact_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("vals").alias("va")), sets.select(F.col("doc_id").alias("b"), F.col("vals").alias("vb"))
    shared = F.size(F.array_intersect("va", "vb"))
    return materialize(pairs.join(left, "a").join(right, "b").where(100 * shared >= percent * (F.size("va") + F.size("vb") - shared)).select("a", "b"), "links")


def _needed(n, k: int, m: int, percent: int):
    """Retained values that two linked sets share at least, from the size of one."""
    return F.when(n * 100 < percent * (k + 1), F.ceil(n * percent / 100)).otherwise(F.lit(m)).cast("int")


def _overlaps(rows: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of intersections of every left with every right set, over the values that two sets hold at least."""
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    _, code, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    place = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[code]
    row, place = row[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(left), len(right)), np.float32)
    n = int((count > 1).sum())
    for lo in range(0, n, 2048):
        part = slice(*np.searchsorted(place, [lo, lo + 2048]))
        has = np.zeros((len(rows), min(2048, n - lo)), np.float32)
        has[row[part], place[part] - lo] = 1
        out += has[left] @ has[right].T
    return out.astype(np.int64)


def tile_links(ids: np.ndarray, comp: np.ndarray, side: np.ndarray, vals: list[np.ndarray], k: int, m: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links across components in one tile (side 2) or between two (sides 0 and 1)."""
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(left) or not len(right):
        return []
    n = np.array([len(v) for v in vals])
    need = np.where(n * 100 < percent * (k + 1), -(-n * percent // 100), m)
    near = _overlaps([v[:k] for v in vals], left, right) >= np.maximum(need[left][:, None], need[right][None, :])
    near &= comp[left][:, None] != comp[right][None, :]
    if not near.any():
        return []
    use_l, use_r = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    left, right, near = left[use_l], right[use_r], near[np.ix_(use_l, use_r)]
    shared = _overlaps(vals, left, right)
    near &= 100 * shared >= percent * (n[left][:, None] + n[right][None, :] - shared)
    joined = np.zeros((len(ids), len(ids)), bool)
    joined[np.ix_(left, right)] = near
    joined |= joined.T
    seen, out = ~joined.any(axis=1), []
    for start in range(len(ids)):
        if seen[start]:
            continue
        seen[start], front = True, np.array([start])
        while len(front):
            sub = joined[front]
            new = np.flatnonzero(sub.any(axis=0) & ~seen)
            out += zip(ids[front[sub[:, new].argmax(axis=0)]].tolist(), ids[new].tolist(), strict=True)
            seen[new], front = True, new
    return out


def _tiles(f, n, tile: int):
    """Tiles for f members whose sets hold n values."""
    return F.greatest(F.ceil(f / tile), F.ceil(n / TILE_VALUES)).cast("int")


def blocks(lists: DataFrame, tile: int = TILE) -> DataFrame:
    """lists (v, rep, n, comp) -> (b, rep, comp, n): members of the union of all lists of one head, or of a list alone where tiles of
    the union would hold more rows than tiles of its lists."""
    rows = (F.col("f") * _tiles(F.col("f"), F.col("n"), tile)).alias("rows")
    each = lists.groupBy("v").agg(F.min("rep").alias("head"), F.count("*").alias("f"), F.sum("n").alias("n")).select("v", "head", rows)
    apart = each.groupBy("head").agg(F.min("v").alias("b"), F.sum("rows").alias("apart"))
    union = lists.join(each.select("v", "head"), "v").groupBy("head", "rep").agg(F.max("n").alias("n"))
    once = union.groupBy("head").agg(F.count("*").alias("f"), F.sum("n").alias("n")).select("head", rows)
    merged = apart.join(once, "head").where("rows <= apart").select("head", "b")
    named = each.join(merged, "head", "left").select("v", F.coalesce("b", "v").alias("b"))
    return lists.join(named, "v").groupBy("b", "rep", "comp").agg(F.max("n").alias("n"))


def tiled(members: DataFrame, tile: int = TILE) -> DataFrame:
    """members (b, rep, comp, n) -> (b, i, j, rep, comp, side): each with every tile of its block that can hold another component.

    Members of a component that fills more than one tile are dealt among tiles of their own, all others of a block among common ones."""
    comps = members.groupBy("b", "comp").agg(F.count("*").alias("f"), F.sum("n").alias("n")).withColumn("own", _tiles(F.col("f"), F.col("n"), tile) > 1)
    comps = comps.withColumn("g", F.when(F.col("own"), F.col("comp")).otherwise(0))
    groups = comps.groupBy("b", "own", "g").agg(_tiles(F.sum("f"), F.sum("n"), tile).alias("tiles"))
    met = groups.groupBy("b").agg(F.collect_list(F.struct("own", "g", "tiles")).alias("groups"))
    dealt = members.join(comps.select("b", "comp", "own", "g"), ["b", "comp"]).join(groups, ["b", "own", "g"]).join(met, "b")
    others = F.filter("groups", lambda x: ~(x["own"] & F.col("own") & (x["g"] == F.col("g"))))
    all_ = F.flatten(F.transform(others, lambda x: F.transform(F.sequence(F.lit(0), x["tiles"] - 1), lambda t: F.struct(x["own"].alias("own"), x["g"].alias("g"), t.alias("t")))))
    at = F.struct("own", "g", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("tiles")).cast("int").alias("t"))
    out = dealt.select("b", "rep", "comp", at.alias("at"), F.explode(all_).alias("o"))
    return out.select("b", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"), "rep", "comp", F.when(F.col("at") == F.col("o"), 2).when(F.col("at") < F.col("o"), 0).otherwise(1).alias("side"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, k: int = SKETCH, m: int = LEAST_SHARED, percent: int = PERCENT, short: int = SHORT_LIST, tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per document."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    s = materialize(sketched(base, "doc_id", "text", size, k), "sketch")
    usable = s.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = usable.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    own = usable.join(classes.select(F.col("rep").alias("doc_id"), "d1", "d2", "n"), ["doc_id", "d1", "d2", "n"], "left_semi")
    reps = materialize(own.dropDuplicates(["doc_id", "d1", "d2"]).select(F.col("doc_id").alias("rep"), "d1", "n", "sketch"), "reps")  # an id with several texts may stand for several classes

    # inverted lists over the rarest values of each sketch
    lists = reps.select("rep", "d1", F.explode("sketch").alias("v"))
    often = lists.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    mine = lists.join(often, "v").groupBy("rep", "d1").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("fv")).join(reps.select("rep", "d1", "n", F.size("sketch").alias("z")), ["rep", "d1"])
    room = F.col("z") - _needed(F.col("n"), k, m, percent) + 1 - (F.col("z") - F.size("fv"))
    ranked = materialize(mine.where(room > 0).select("rep", "n", F.explode(F.slice("fv", F.lit(1), room)).alias("x")).select("rep", "n", "x.v"), "ranked")
    held = ranked.groupBy("v").agg(F.count("*").alias("f")).where("f > 1").select("v")
    posts = materialize(ranked.join(held, "v"), "lists")
    sets = materialize(full_sets(base.withColumn("th", F.xxhash64("text")).join(posts.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "th"]), size), "sets")
    discard(ranked)

    # one partner for each class: the head that it meets in most lists
    heads = posts.groupBy("v").agg(F.min("rep").alias("head"), F.count("*").alias("f")).where("f > 1")
    met = posts.join(heads, "v").where("rep > head").groupBy("rep", "head").agg(F.count("*").alias("c"))
    best = met.groupBy("rep").agg(F.max(F.struct("c", (-F.col("head")).alias("h"))).alias("x")).select(F.col("rep").alias("a"), (-F.col("x.h")).alias("b"))
    first_pairs = materialize(best, "pairs")
    links = exact_links(first_pairs, sets, percent)
    several = usable.groupBy("doc_id").agg(F.min("d1").alias("i"), F.max("d1").alias("j")).where("i <> j").select("doc_id")
    same_id = usable.join(several, "doc_id").join(classes, ["d1", "d2", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    label = materialize(components(links.unionByName(same_id)), "label")

    # lists that hold several components: pairs across them
    tagged = posts.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("v", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    mixed = materialize(tagged, "tagged")
    open_lists = mixed.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("f")).where("lo < hi").select("v", "f")
    rest = materialize(mixed.join(open_lists, "v"), "open")
    few = rest.where(F.col("f") <= short)
    x, y = few.select("v", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca")), few.select("v", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    fits = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    near = x.join(y, "v").where(fits).select("a", "b").distinct()
    sk = lambda c: reps.select(F.col("rep").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
    shared = F.size(F.array_intersect(F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k), F.array_intersect("sa", "sb")))
    near = near.join(sk("a"), "a").join(sk("b"), "b").where(shared >= F.greatest(_needed(F.col("na"), k, m, percent), _needed(F.col("nb"), k, m, percent))).select("a", "b")

    many = materialize(rest.where(F.col("f") > short).select("rep", "n", "comp", "v"), "long")
    members = materialize(blocks(many, tile), "blocks")

    def compare(t: pa.Table) -> pa.Table:
        vals = t.column("vals").combine_chunks()
        ends, flat = vals.offsets.to_numpy(), vals.values.to_numpy()
        ids, comp, side = (t.column(c).to_numpy() for c in ("rep", "comp", "side"))
        out = tile_links(ids, comp, side, [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], k, m, percent)
        return pa.table({c: pa.array([x[i] for x in out], pa.int64()) for i, c in enumerate("ab")})

    far = tiled(members, tile).join(sets.withColumnRenamed("doc_id", "rep"), "rep").groupBy("b", "i", "j").applyInArrow(compare, "a long, b long")
    pairs = materialize(near, "pairs")
    few_links, many_links = exact_links(pairs, sets, percent), materialize(far.distinct(), "far")
    more = few_links.unionByName(many_links)
    name = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    joined = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    last = components(joined).select(F.col("node").alias("component"), F.col("component").alias("top"))
    final = materialize(
        label.join(last, "component", "left").select("node", F.coalesce("top", "component").alias("c")).unionByName(last.select(F.col("component").alias("node"), F.col("top").alias("c"))).groupBy("node").agg(F.min("c").alias("c")), "final"
    )
    named = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("c", "rep").alias("component"))
    out = s.join(named, ["d1", "d2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    discard(reps, posts, first_pairs, links, label, mixed, rest, many, members, sets, pairs, few_links, many_links)
    return out

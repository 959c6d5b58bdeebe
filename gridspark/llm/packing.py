"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token ids; only longer ones are cut, into pieces of `capacity`.  What the driver sees is the histogram of
piece lengths, at most `capacity` numbers whatever the corpus.  A configuration is a multiset of lengths that fits a
sequence.  The covering program - fewest sequences so that every length is covered as often as it occurs - is solved by
multiplicative weights: each length's price falls exponentially with the covered share of its count, the best
configuration at these prices comes from a knapsack dynamic program, and it is used for a small part of its scarcest
length.  From there simplex steps with the same knapsack lead to the program's optimum.  More than GROUPS lengths are first rounded up to so many, with the least waste; pieces keep their own lengths.
Whole uses come from rounding down or up, best-fit decreasing adds what is left, and the plan of fewest sequences among these
and plain best-fit decreasing is taken.  Where best fit alone meets total length / capacity, nothing can be better.

Each piece's rank within its length (counted in its task, on from the tasks before) then finds its sequence and offset by
a binary search in the plan, so nothing about single pieces passes the driver.

Defined cases: null text is empty and still one piece (its end id); repeated rows and null ids are packed as rows of their
own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import SPACES, ascii_lower, first_bytes, materialize, prefix_hash, running, slices, span_hash, text_buffer, word_bounds

CAPACITY, END_ID, TOKENIZER, ROUNDS, CACHE, SLAB_BYTES = 2048, 0, "word_bpe_49k.json", 800, 1_000_000, 1 << 20
#: Of the covering program: accuracy aimed at, rows it has at most, and knapsacks solved at most (about).
ACCURACY, GROUPS, STEPS = 0.01, 96, 6000


# ---- tokens -------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def _plain(path: str):
    """The same merges for lower-case ASCII words, which need no other step than the split at spaces."""
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer(_tokenizer(path).model)
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return t


@functools.lru_cache(maxsize=2)
def _word_ends(path: str) -> np.ndarray:
    """For each id whether it ends a word (its string has the vocabulary's end mark)."""
    t = _tokenizer(path)
    out = np.zeros(t.get_vocab_size() + 1, bool)
    for word, i in t.get_vocab().items():
        out[i] = word.endswith("</w>")
    return out


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?|")] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_kept: dict[str, WordIds] = {}


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] numbers), then from first[1] on, and so forth."""
    stop = np.cumsum(size)
    return np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(first - (stop - size), size)


class WordIds:
    """Ids of texts under a tokenizer that never joins across white space: parts of words are encoded once and kept.

    The vocabulary folds A-Z itself and drops white space, so words split at ASCII white space and with A-Z lowered give
    the ids of the whole text; so do a word up to a last letter a-z and the punctuation behind it.  Parts of letters
    only are one pre-token each: many are encoded as one string and told apart by the end-of-word ids; any other part is encoded
    alone.  What is known lies in vectors, ordered by the fingerprint of the part's bytes and checked by its first 8, and stays
    between tasks; a worker starts anew beyond `most` parts."""

    def __init__(self, path: str, most: int = CACHE):
        self.tokenizer, self.plain, self.ends, self.most = _tokenizer(path), _plain(path), _word_ends(path), most
        self.forget()

    def forget(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _joined(self, tokenizer, text: str, parts: int) -> tuple[np.ndarray, np.ndarray] | None:
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        stop = np.flatnonzero(self.ends[ids]) + 1
        return (np.diff(stop, prepend=0), ids) if len(stop) == parts else None  # else some part is more than one pre-token

    def _encoded(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each part, all ids) of parts of data."""
        small = np.append(0, np.cumsum(_SMALL[data]))
        plain = np.flatnonzero(small[start + size] - small[start] == size)
        other = np.setdiff1d(np.arange(len(start)), plain, assume_unique=True)
        text = [data[a : a + n].tobytes() for a, n in zip(start[other].tolist(), size[other].tolist(), strict=True)]
        words = [w.decode("utf-8", "replace") for w in text]
        letters = [i for i, w in enumerate(words) if w.isalpha()]
        alone, counts, found = [i for i, w in enumerate(words) if not w.isalpha()], np.zeros(len(start), np.int64), []
        for lo in range(0, len(plain), 4096):
            at = plain[lo : lo + 4096]
            long_ = size[at] + 1
            joined = np.full(int(long_.sum()), 32, np.uint8)
            joined[_spread(np.cumsum(long_) - long_, size[at])] = data[_spread(start[at], size[at])]
            got = self._joined(self.plain, joined.tobytes().decode(), len(at))
            if got is None:
                raise ValueError("the vocabulary has words of small letters that it takes apart")
            found.append((at, *got))
        for lo in range(0, len(letters), 4096):
            at = letters[lo : lo + 4096]
            got = self._joined(self.tokenizer, " ".join(words[i] for i in at), len(at))
            if got is None:
                alone += at
            else:
                found.append((other[at], *got))
        for lo in range(0, len(alone), 4096):
            at = alone[lo : lo + 4096]
            each = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in at], add_special_tokens=False)]
            found.append((other[at], np.array([len(x) for x in each], np.int64), np.array([i for x in each for i in x], "<u4")))
        first, base = np.zeros(len(start), np.int64), 0
        for at, n, ids in found:
            counts[at], first[at] = n, base + np.cumsum(n) - n
            base += len(ids)
        ids = np.concatenate([np.zeros(0, "<u4"), *(x for _, _, x in found)])
        return counts, ids[_spread(first, counts)]

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's ids begin, with the end) of UTF-8 texts that stand one after another."""
        n = len(offsets) - 1
        low = np.full(len(data) + n, 32, np.uint8)  # a space behind every text
        low[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = ascii_lower(data)
        text_end = offsets[1:] + np.arange(1, n + 1)
        start, stop = word_bounds(low)
        cut = np.flatnonzero(_SMALL[low[:-1]] & _PUNCTUATION[low[1:]]) + 1
        others = np.flatnonzero(~_PUNCTUATION[low])
        cut = cut[np.isin(low[others[np.searchsorted(others, cut)]], list(SPACES))]
        start, stop = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([stop, cut]))
        prefix = prefix_hash(low)
        key = span_hash(prefix, start, stop)
        key, where, code = np.unique(key, return_index=True, return_inverse=True)
        a, b = start[where], stop[where]
        check = first_bytes(prefix, a, b)
        if len(self.key) + len(key) > self.most:
            self.forget()
        slot = np.searchsorted(self.key, key)
        near = np.minimum(slot, max(0, len(self.key) - 1))
        have = (self.key[near] == key) & (self.check[near] == check) if len(self.key) else np.zeros(len(key), bool)
        new = np.flatnonzero(~have)
        size, ids = self._encoded(low, a[new], b[new] - a[new])
        table = np.concatenate([self.ids, ids])
        first, count = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        first[have], count[have] = self.first[near[have]], self.size[near[have]]
        first[new], count[new] = len(self.ids) + np.cumsum(size) - size, size
        each = count[code]
        out = table[_spread(first[code], each)]
        begin = np.append(0, np.cumsum(each))[np.searchsorted(start, np.append(0, text_end))]
        at = slot[new]
        self.key, self.check = np.insert(self.key, at, key[new]), np.insert(self.check, at, check[new])
        self.first, self.size, self.ids = np.insert(self.first, at, first[new]), np.insert(self.size, at, size), table
        return out, begin


def token_pieces(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int = CAPACITY, end_id: int = END_ID, most_words: int = CACHE, copy_col: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids[, copy], _task, _nth): the pieces of every document; _nth counts a task's pieces of one length."""

    def work(batches):
        task = TaskContext.get().partitionId()
        if path not in _kept:
            _kept[path] = WordIds(path)
        words, seen = _kept[path], np.zeros(capacity + 1, np.int64)
        words.most = most_words
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets, SLAB_BYTES):
                ids, begin = words.of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n, size = hi - lo, np.diff(begin) + 1
                full = np.full(len(ids) + n, end_id, "<u4")
                full[_spread(begin[:-1] + np.arange(n), size - 1)] = ids
                pieces = -(-size // capacity)
                row = np.repeat(np.arange(n), pieces)
                piece = _spread(np.zeros(n, np.int64), pieces)
                length = np.minimum(capacity, size[row] - piece * capacity)
                order = np.argsort(length, kind="stable")
                same = length[order]
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(order)) - np.searchsorted(same, same) + seen[same]
                seen += np.bincount(length, minlength=capacity + 1)
                ends = np.append(0, np.cumsum(length * 4)).astype(np.int32)
                take = pa.array(row + lo)
                cols = [batch.column(0).take(take), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(full)])]
                cols += [c.take(take) for c in batch.columns[2:]] + [pa.array(np.full(len(length), task, np.int32)), pa.array(nth)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids", *["copy"] * bool(copy_col), "_task", "_nth"])

    copy = [F.col(copy_col).cast("long").alias("copy")] if copy_col else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *copy)
    return rows.mapInArrow(work, "doc_id long, piece int, start long, length long, ids binary" + ", copy long" * bool(copy_col) + ", _task int, _nth long")


# ---- plan ---------------------------------------------------------------------------------------


def best_configuration(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> Counter:
    """The most valuable multiset of lengths that fits the capacity (knapsack dynamic program, copies by powers of two)."""
    best, steps = np.zeros(capacity + 1), []
    for length, price in zip(lengths.tolist(), prices.tolist(), strict=True):
        left, k = capacity // length, 1
        while left > 0:
            k = min(k, left)
            size = k * length
            value = best[: capacity + 1 - size] + k * price
            steps.append((length, k, size, value > best[size:]))
            np.maximum(best[size:], value, out=best[size:])
            left, k = left - k, 2 * k
    out, c = Counter(), capacity
    for length, k, size, taken in reversed(steps):
        if c >= size and taken[c - size]:
            out[length] += k
            c -= size
    return out


def solve_covering(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[tuple, float]:
    """Fractional use of configurations that covers every length as often as it occurs, by multiplicative weights.

    A length's weight starts at 1 and falls as exp(-eta coverage / count); a piece costs weight / count, and the
    configuration of most value is used until the scarcest of its lengths has 1 / eta more of its count.  Covered lengths
    drop out.  eta = log(lengths) / ACCURACY as far as `rounds` steps a length, and STEPS in all, allow."""
    covered, use = np.zeros(len(lengths)), defaultdict(float)
    at = {int(x): i for i, x in enumerate(lengths)}
    eta = max(2.0, min(np.log(len(lengths) + 1) / ACCURACY, rounds, STEPS / len(lengths)))
    while (open_ := covered < 1 - 1e-9).any():
        prices = np.exp(-eta * (covered[open_] - covered[open_].min())) / counts[open_]
        p = best_configuration(lengths[open_], prices, capacity)
        where, times = np.array([at[x] for x in p]), np.array(list(p.values()))
        step = float((counts[where] / times).min()) / eta
        covered[where] += step * times / counts[where]
        use[tuple(sorted(p.items()))] += step
    return use


def exchanged(lengths: np.ndarray, counts: np.ndarray, capacity: int, use: dict[tuple, float], steps: int = STEPS) -> dict[tuple, float]:
    """The covering program's optimum from the weights' configurations: simplex steps, which bring in a configuration of use
    or, where none of those helps, the knapsack's, until at the basis' prices none is worth more than one sequence."""
    at = {int(x): i for i, x in enumerate(lengths)}

    def column(config) -> np.ndarray:
        out = np.zeros(len(lengths))
        for k, t in config:
            out[at[k]] = t
        return out

    configs = [((int(k), int(capacity // k)),) for k in lengths]
    basis = np.diag((capacity // lengths).astype(float))
    x = counts / np.diag(basis)
    found = list(use)
    columns = np.array([column(c) for c in found]).T
    for _ in range(steps):
        prices = np.linalg.solve(basis.T, np.ones(len(lengths)))
        worth = prices @ columns
        j = int(np.argmax(worth))
        if worth[j] > 1 + 1e-7:
            config, new = found[j], columns[:, j]
        else:
            dear = prices > 1e-12
            config = tuple(sorted(best_configuration(lengths[dear], prices[dear], capacity).items()))
            new = column(config)
            if prices @ new <= 1 + 1e-7:
                break
        change = np.linalg.solve(basis, new)
        ratio = np.where(change > 1e-9, x / np.where(change > 1e-9, change, 1), np.inf)
        r = int(np.argmin(ratio))
        x = np.maximum(x - ratio[r] * change, 0)
        x[r], basis[:, r], configs[r] = ratio[r], new, config
    out: dict[tuple, float] = defaultdict(float)
    for config, n in zip(configs, x.tolist(), strict=True):
        out[config] += n
    return out


def grouped(lengths: np.ndarray, counts: np.ndarray, most: int = GROUPS) -> list[list[int]]:
    """Positions of the lengths (ascending) in at most `most` runs, longest first, with the waste of rounding up within a
    run as small as that allows; so a frequent length stays alone."""

    def runs(waste: int) -> list[list[int]]:
        out, lost = [], 0
        for i in range(len(lengths) - 1, -1, -1):
            lost += int(lengths[out[-1][0]] - lengths[i]) * int(counts[i]) if out else 0
            if not out or lost > waste:
                out.append([])
                lost = 0
            out[-1].append(i)
        return out

    lo, hi = 0, int((lengths[-1] - lengths) @ counts)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if len(runs(mid)) <= most else (mid + 1, hi)
    return runs(lo)


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int, begun: Counter | None = None) -> Counter:
    """Best-fit decreasing on counts, into the sequences begun and new ones: (configuration) -> sequences."""
    free: list[Counter] = [Counter() for _ in range(capacity + 1)]  # configurations by room left
    for config, n in (begun or {}).items():
        free[capacity - sum(k * t for k, t in config)][config] += n
    for length, n in sorted(zip(lengths.tolist(), counts.tolist(), strict=True), reverse=True):
        room = length
        while n:
            while room <= capacity and not free[room]:
                room += 1
            if room > capacity:  # none has room: open new sequences
                each = capacity // length
                if q := n // each:
                    free[capacity - each * length][((length, each),)] += q
                if r := n - q * each:
                    free[capacity - r * length][((length, r),)] += 1
                break
            config, have = free[room].popitem()
            q = min(n, have)
            if have > q:
                free[room][config] += have - q
            more = Counter(dict(config))
            more[length] += 1
            free[room - length][tuple(sorted(more.items()))] += q
            n -= q
            room = length
    out: Counter = Counter()
    for x in free:
        out.update(x)
    return out


def rounded(use: list[tuple[tuple, int]], groups: dict[int, list[list[int]]], lengths: np.ndarray, counts: np.ndarray, capacity: int) -> Counter:
    """Whole sequences: each configuration as often as asked while its groups have pieces, the rest by best fit."""
    runs = {g: [list(x) for x in members] for g, members in groups.items()}  # [length, pieces left], longest first
    have = {g: sum(n for _, n in members) for g, members in groups.items()}
    begun: Counter = Counter()
    for config, n in use:
        n = min([n, *(have[g] // t for g, t in config)])
        while n > 0:
            whole = min([n, *(runs[g][0][1] // t for g, t in config)])
            filled: Counter = Counter()
            for g, t in config:
                have[g] -= max(1, whole) * t
                need = max(1, whole) * t
                while need:
                    q = min(need, runs[g][0][1])
                    filled[runs[g][0][0]] += q // whole if whole else q
                    runs[g][0][1] -= q
                    need -= q
                    if not runs[g][0][1]:
                        runs[g].pop(0)
            begun[tuple(sorted(filled.items()))] += max(1, whole)
            n -= max(1, whole)
    left = {k: n for members in runs.values() for k, n in members if n}
    keys = np.array(sorted(left), np.int64)
    return best_fit(keys, np.array([left[int(k)] for k in keys], np.int64), capacity, begun)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Counter:
    """Configurations (sorted (length, times) pairs) and how many sequences use each; covers the histogram exactly."""
    out: Counter = Counter()
    rest = {length: n for length, n in histogram.items() if n}
    if n := rest.pop(capacity, 0):
        out[((capacity, 1),)] = n
    if rest:
        lengths = np.array(sorted(rest), np.int64)
        counts = np.array([rest[int(x)] for x in lengths], np.int64)
        best = best_fit(lengths, counts, capacity)
        if sum(best.values()) > -(-int(lengths @ counts) // capacity):  # else no packing has fewer
            groups = {int(lengths[g[0]]): [[int(lengths[i]), int(counts[i])] for i in g] for g in grouped(lengths, counts)}
            sizes = np.array(sorted(groups), np.int64)
            need = np.array([sum(n for _, n in groups[int(g)]) for g in sizes], float)
            use = exchanged(sizes, need, capacity, solve_covering(sizes, need, capacity, rounds))
            size = lambda config: sum(k * t for k, t in config)
            for order in (lambda c: (-use[c], c), lambda c: (-size(c), -use[c], c)):
                for whole in (lambda x: int(x + 1e-9), lambda x: int(np.ceil(x - 1e-9))):
                    made = rounded([(c, whole(use[c])) for c in sorted(use, key=order)], groups, lengths, counts, capacity)
                    best = min(best, made, key=lambda x: sum(x.values()))
        out.update(best)
    return out


class Places:
    """Where the r-th piece of a length goes."""

    def __init__(self, configs: Counter):
        rows, ranks, first = [], defaultdict(int), 0
        for config, n in sorted(configs.items()):
            offset = 0
            for length, times in config:
                rows.append((length, ranks[length], first, times, offset))
                ranks[length] += n * times
                offset += length * times
            first += n
        rows.sort()
        self.length, self.rank, self.first, self.times, self.offset = np.array(rows, np.int64).reshape(-1, 5).T
        self.key = self.length * (1 << 44) + self.rank

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = np.searchsorted(self.key, length * (1 << 44) + rank, side="right") - 1
        seq, copy = np.divmod(rank - self.rank[g], self.times[g])
        return self.first[g] + seq, self.offset[g] + copy * length


def packed(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """pieces (length, _task, _nth, ...) with sequence_id and offset for the last two; pieces should be a written table.

    A piece's rank in its length is the number of that length's pieces in the tasks before plus its own number there."""
    names = [c for c in pieces.columns if c not in ("_task", "_nth")]
    sums = materialize(pieces.groupBy("length", "_task").agg(F.count("*").alias("_n")), "sums")
    histogram = {int(r["length"]): int(r["n"]) for r in sums.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    base = running(sums, ["length"], "_task", "_n", "_base")
    ranked = pieces.join(base, ["length", "_task"]).select(*names, (F.col("_base") + F.col("_nth")).cast("long").alias("_rank"))
    places = Places(plan(histogram, capacity, rounds))

    def place(batches):
        for batch in batches:
            seq, offset = places.of(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*names).schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False, most_words: int = CACHE, copy_col: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids][, copy], sequence_id, offset).

    The pieces' ids (little-endian, 32 bits) are written with them in any case, and the checksum is taken of what is
    read back; with keep_ids they go along to the sequences.  copy is docs' number for rows of one id.  A worker keeps up to
    most_words encoded parts of words."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    pieces = materialize(token_pieces(docs, id_col, text_col, path, capacity, most_words=most_words, copy_col=copy_col), "pieces")
    copy = ["copy"] * bool(copy_col)
    return packed(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *["ids"] * keep_ids, *copy, "_task", "_nth"), capacity)

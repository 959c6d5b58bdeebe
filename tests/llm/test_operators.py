"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeats, empty tables and
extra columns."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "ta", "vo", "su") for b in ("n", "r", "st", "le", "", "ko")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, v string, id string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1):
    """(doc_id, text): distinct, copied, near-copied, short, long, empty and null texts, shared passages and odd bytes."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(5, 120)) for _ in range(40)]
    base, passage = prose(rng, 200), prose(rng, 90)
    texts += [texts[3]] * 3 + [texts[5].upper().replace(" ", "\n", 4)]
    for _ in range(30):
        w = base.split()
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += [prose(rng, 30) + passage + prose(rng, 30) for _ in range(12)]
    texts += [None, "", " \n\t ", "un", "deux mots", "un deux trois quatre", "un deux trois quatre", "ab" * 700, "é" * 450, "x" * 399, "x" * 400, prose(rng, 3000), "  nbsp  em ½ <|endoftext|> 'll don't a,b.c!!", "12345 678"]
    return [(i, t) for i, t in enumerate(texts)]


def documents(spark, rows):
    full = [(i, t, ("en", "fr", None)[(i or 0) % 3], (None, "a", "b", "hot", "hot")[(i or 0) % 5], len(t or ""), 7, "x", "y") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    documents(spark, rows).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1 ------------------------------------------------------------------------------------------


def test_topk(spark, empty):
    from gridspark.llm.topk import search_block, threshold_topk

    rng = np.random.default_rng(3)
    vecs = [(i, rng.normal(0, 0.1, 8).round(3).tolist()) for i in range(300)]
    vecs[10] = (10, vecs[0][1])
    vecs += [vecs[7], (1000, None), (1001, [0.1, None] * 4), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (None, [0.5] * 8), (1050, [0.1, 0.2]), (1100, [1e30] * 8)]
    df = spark.createDataFrame([(*v, 1, "x") for v in vecs], "vec_id long, embedding array<double>, label int, d string")
    got = defaultdict(list)
    for r in threshold_topk(df, lambda i: i % 50 == 0, block_rows=64, query_rows=3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    q = {i: np.array([min(max(int(np.floor(256 * x)), -(2**63)), 2**63 - 1) for x in v], object) for i, v in vecs if i is not None and v and None not in v and np.isfinite(np.array(v)).all()}
    for i in (x for x in q if x % 50 == 0):
        every = sorted(((min(max(int(q[i] @ v), 1 - 2**63), 2**63 - 1), j) for j, v in q.items() if j != i and len(v) == len(q[i])), key=lambda s: (-s[0], s[1]))
        assert got[i] == [(j, s) for s, j in every[:5]], i
    assert threshold_topk(spark.createDataFrame([], df.schema), lambda i: i % 50 == 0).count() == 0
    m = np.zeros((1000, 4), np.int64)
    m[:20] = 50
    (_, ids, scores, scored) = next(iter(search_block(np.arange(1000), m, np.array([-1]), np.array([[1, 1, 1, 1]]), 5)))
    assert ids.tolist() == [0, 1, 2, 3, 4] and scored < 1000  # stops early


# ---- 2 ------------------------------------------------------------------------------------------


def test_licences(spark, empty):
    from gridspark.llm.licences import KNOWN, notices, scanned

    mit = KNOWN[0][1]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(". ", ".\n\n * ")), (3, mit + " more"), (4, None), (5, ""), (6, "x\nReleased under the MIT Licence\n"), (1, mit), (None, mit.replace(",", " ;"))]
    df = documents(spark, rows)
    got = [(r["doc_id"], r["licence_id"]) for r in scanned(df).collect()]
    assert Counter(got) == Counter([(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, None), (1, "MIT"), (None, "MIT")])
    assert [tuple(r) for r in notices(df.where("doc_id = 6")).collect()] == [(6, 1, "MIT")]
    plan = scanned(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert scanned(empty).count() == 0


def test_copyright_lines_end_where_they_end(spark):
    from gridspark.llm.licences import KNOWN, scanned

    mit, notice = KNOWN[0][1], "Released under the MIT License."
    rows = [(1, "Copyright (c) 2020 X\nAll rights reserved.\n" + mit), (2, "All rights reserved.\nanything\n" + notice), (3, notice + "\nAll rights reserved. "), (4, "(c) 2020 X\nall rights reserved\n\n" + notice)]
    assert {r["doc_id"]: r["licence_id"] for r in scanned(documents(spark, rows)).collect()} == {1: "MIT", 2: None, 3: "MIT", 4: "MIT"}


def test_notices_need_no_certain_word(spark):
    from gridspark.llm.licences import KNOWN, known_digests, notices

    df = documents(spark, [(1, "x\n" + KNOWN[1][1] + "\n\n"), (2, "y\nDo as you like!\n"), (3, None)])
    assert [tuple(r) for r in notices(df).collect()] == [(1, 1, "ISC")]
    assert [tuple(r) for r in notices(df, known_digests(spark, [("own", "do as you like")])).collect()] == [(2, 1, "own")]


def test_licence_table(spark):
    from gridspark.llm.licences import KNOWN, TEXTS, catalogue, known_digests, notices, scanned

    assert Counter(map(tuple, known_digests(spark).collect())) == Counter(map(tuple, known_digests(spark, catalogue()).collect()))
    names = sorted(p.stem for p in TEXTS.glob("*.txt"))
    whole = {i: (TEXTS / f"{x}.txt").read_text() for i, x in enumerate(names)} | {100: "MIT License\n\nCopyright (c) 2021 Someone\n\n" + KNOWN[0][1], 101: "BSD 3-Clause License\n\nCopyright (c) 2021, X\nAll rights reserved.\n\n" + (TEXTS / "BSD-3-Clause.txt").read_text()}
    got = {r["doc_id"]: r["licence_id"] for r in scanned(documents(spark, list(whole.items()))).collect()}
    assert got == {**dict(enumerate(names)), 100: "MIT", 101: "BSD-3-Clause"}
    lines = ['Licensed under the Apache License, Version 2.0 (the "License")', "# SPDX-License-Identifier: BSD-3-Clause", "This project is licensed under the MIT License - see the LICENSE file for details.", "licensed to nobody"]
    assert [tuple(r)[1:] for r in notices(documents(spark, [(1, "\n".join(lines))])).orderBy("line").collect()] == [(0, "Apache-2.0"), (1, "BSD-3-Clause"), (2, "MIT")]


# ---- 3 ------------------------------------------------------------------------------------------


def test_gif_round_trip(docs, rows, empty):
    from gridspark.llm.gif import media_columns, stored, timed_frames

    media = media_columns(stored(docs))
    got = {r["doc_id"]: r for r in media.collect()}
    for i, t in rows:
        raw = (t or "").encode()
        pay = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert bytes(got[i]["samples"]) == pay and got[i]["n_bytes"] == len(raw)
        assert [sum(h) for h in got[i]["histograms"]] == [576] * (len(pay) // 576) and got[i]["starts_ms"] == [100 * k for k in range(len(pay) // 576)]
    frames = timed_frames(media, "doc_id")
    assert frames.count() == sum(len(r["delays_ms"]) for r in got.values()) and frames.where("octet_length(pixels) <> 576").count() == 0
    assert media_columns(stored(empty)).count() == 0


def test_lzw_streams():
    from gridspark.llm.gif import lzw_codes, lzw_decode, lzw_decode_many, pack_codes

    rng = np.random.default_rng(0)
    for n in (1, 2, 576, 9000, 60000):
        datas = [rng.integers(0, k, n, dtype=np.uint8).tobytes() for k in (1, 2, 3, 200, 256)]
        packed = pack_codes([lzw_codes(x) for x in datas])
        for x, s in zip(datas, packed, strict=True):
            assert lzw_decode(s, 8, n).tobytes() == x
        assert [r.tobytes() for r in lzw_decode_many(packed, 8, n)] == datas
    assert lzw_decode_many([packed[0][: len(packed[0]) // 2]], 8, n).shape == (1, n)  # cut short
    small = pack_codes([lzw_codes(bytes([0, 1, 2, 3, 3, 2, 1, 0] * 20), 2)], 2)
    assert lzw_decode(small[0], 2, 160).tobytes() == bytes([0, 1, 2, 3, 3, 2, 1, 0] * 20) == lzw_decode_many(small, 2, 160)[0].tobytes()


def test_gif_rules():
    from gridspark.llm.gif import composed, decode_many, parse

    c = bytes([0, 0, 0, 10, 20, 30, 200, 0, 0])
    f = lambda **k: {"x": 0, "y": 0, "w": 2, "h": 2, "colours": c, "interlaced": False, "disposal": 0, "clear": None} | k
    px = [np.array([1, 1, 1, 1]), np.array([2, 0]), np.array([2]), np.array([1, 0, 0, 2])]
    out = composed(2, 2, [f(), f(w=2, h=1, clear=0, disposal=3), f(w=1, h=1, x=1, y=1, disposal=2), f(clear=0)], px)
    assert out[1, 0].tolist() == [[200, 0, 0], [10, 20, 30]] and out[2, 0, 0].tolist() == [10, 20, 30] and out[2, 1, 1].tolist() == [200, 0, 0]
    assert out[3, 1].tolist() == [[10, 20, 30], [200, 0, 0]] and out[3, 0, 1].tolist() == [10, 20, 30]
    rows = composed(1, 5, [f(w=1, h=5, interlaced=True)], [np.array([0, 1, 2, 1, 2])])[0, :, 0, 0].tolist()
    assert rows == [0, 10, 200, 200, 10]  # rows 0, 4, 2, then 1, 3 of the stream
    assert parse(b"not a gif") is None and decode_many([None, b"", b"GIF89a"]) == [None, None, None]


def test_gif_colours(spark, docs):
    from gridspark.llm.gif import lzw_codes, media_columns, pack_codes, stored, timed_frames

    def file(colours, frames, flags=0xF7):
        table = bytes(colours).ljust(768, b"\0")
        out = b"GIF89a\2\0\1\0" + bytes([flags]) + b"\0\0" + table
        for f, at in frames:
            (data,) = pack_codes([lzw_codes(bytes(f))])
            out += b"\x21\xf9\x04" + bytes([4, 5, 0, 0]) + b"\0\x2c" + bytes([at, 0, 0, 0, len(f), 0, 1, 0]) + b"\0\x08" + bytes([len(data)]) + data + b"\0"
        return out + b";"

    colours = [100, 0, 0, 0, 50, 5, 1, 2, 250]  # the first two of one luma
    rows = [(1, file(colours, [([0, 0], 0), ([1, 1], 0)])), (2, file(colours, [([0, 2], 0), ([1], 1)])), (3, b"no gif"), (4, None)]
    media = media_columns(spark.createDataFrame(rows, "doc_id long, gif binary"))
    got = {(r["doc_id"], r["frame"]): r for r in timed_frames(media, "doc_id").collect()}
    rgb = lambda k: list(zip(*(bytes(got[k][c]) for c in ("red", "green", "blue")), strict=True))
    assert rgb((1, 0)) == [(100, 0, 0)] * 2 and rgb((1, 1)) == [(0, 50, 5)] * 2 and rgb((2, 0)) == [(100, 0, 0), (1, 2, 250)] and rgb((2, 1)) == [(100, 0, 0), (0, 50, 5)]
    assert got[(1, 0)]["pixels"] == got[(1, 1)]["pixels"] and got[(1, 0)]["colour_histogram"] != got[(1, 1)]["colour_histogram"]
    assert {i: n for i, n in enumerate(got[(2, 0)]["colour_histogram"]) if n} == {6: 1, 0: 1, 16: 2, 32: 1, 47: 1} and len(got) == 4
    grey = media_columns(stored(docs)).where("red <> samples or green <> red or blue <> red")
    assert grey.count() == 0


# ---- 4 ------------------------------------------------------------------------------------------


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize("short, tile", [(16, 768), (2, 5)])
def test_near_duplicates(docs, rows, short, tile):
    from gridspark.llm.neardup import near_duplicates

    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, short=short, tile=tile).collect()}
    assert got == linked(rows)


def test_tiles_of_a_large_group_grow_as_its_members(spark):
    from gridspark.llm.neardup import blocks, tiled

    def lists(n):  # 12 lists of a large component and 30 that it has not taken up, 5 small ones apart from these
        rng = random.Random(n)
        out = [(v, rep, 5, -1 if rep < n else rep) for v in range(12) for rep in range(n + 30) if rep in (0, n) or rng.random() < 0.9]
        return out + [(20 + v, 9000 + 100 * v + i, 5, 9000 + i % 3) for v in range(5) for i in range(20)]

    made = []
    for n in (400, 800):
        data = lists(n)
        rows = tiled(blocks(spark.createDataFrame(data, "v long, rep long, n long, comp long"), 40), 40).collect()
        made.append(len(rows))
        comp, met, of = {rep: c for _, rep, _, c in data}, Counter(), defaultdict(list)
        for r in rows:
            of[r["b"], r["i"], r["j"]].append((r["rep"], r["side"]))
        for x in of.values():
            met.update({(min(a, b), max(a, b)) for a, p in x for b, q in x if a != b and comp[a] != comp[b] and (p != q or p == 2)})
        share = defaultdict(set)
        for v, rep, _, _ in data:
            share[v].add(rep)
        assert {(a, b) for x in share.values() for a in x for b in x if a < b and comp[a] != comp[b]} == set(met) and set(met.values()) == {1}
    assert made[1] <= 2.2 * made[0] and made[1] < 5000  # tiles of each list as it stands: 12 * 830 * 0.9 members, each in 19 tiles


def test_near_duplicates_edges(spark, empty):
    from gridspark.llm.neardup import near_duplicates

    assert near_duplicates(empty).count() == 0
    got = Counter(tuple(r) for r in near_duplicates(documents(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (2, "A  b"), (3, None)])).collect())
    assert got == Counter({(1, 1, 1, True): 2, (None, 1, None, True): 1, (2, 1, 1, False): 1, (3, 0, 3, True): 1})


def test_rows_of_one_id_are_one_document(spark):
    from gridspark.llm.neardup import near_duplicates

    rng = random.Random(21)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(5, a), (5, b), (7, a + " ko"), (8, b + " ko"), (9, c), (3, c + " ko"), (9, b), (20, prose(rng, 60)), (20, prose(rng, 60)), (21, None), (21, "x")]
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(documents(spark, rows)).collect())
    assert got == Counter([(5, 3, False)] * 2 + [(7, 3, False), (8, 3, False), (3, 3, True)] + [(9, 3, False)] * 2 + [(20, 20, True)] * 2 + [(21, 21, True)] * 2)


def test_components(spark):
    from gridspark.llm.components import components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (5, 5), (None, 3), (7, 6)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 150: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 5 ------------------------------------------------------------------------------------------


def test_packing(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from gridspark.llm.packing import pack_documents

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[a : a + 64], "<u4").tobytes()
            want[(i, k, a, len(part) // 4, zlib.crc32(part))] += 1
    got = pack_documents(docs, capacity=64).collect()
    assert Counter(tuple(r[:5]) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(parts[-1]) <= 64
    assert len(seqs) <= 1.03 * sum(n for p in seqs.values() for _, n in p) / 64 + 2
    assert pack_documents(empty).count() == 0


def test_plan_covers_every_histogram():
    from gridspark.llm.packing import Places, best_configuration, plan

    rng = np.random.default_rng(5)
    for _ in range(6):
        hist = {int(k): int(v) for k, v in zip(rng.integers(1, 101, 30), rng.integers(1, 400, 30), strict=True)}
        configs = plan(hist, 100, 60)
        seen = Counter()
        for c, n in configs.items():
            assert sum(k * v for k, v in c) <= 100
            for k, v in c:
                seen[k] += v * n
        assert seen == hist
        places = Places(configs)
        for k, v in hist.items():
            seq, off = places.of(np.full(v, k), np.arange(v))
            assert len(set(zip(seq.tolist(), off.tolist(), strict=True))) == v
    assert best_configuration(np.array([3, 5]), np.array([3.0, 5.1]), 11) == {3: 2, 5: 1}
    assert plan({}, 100) == {}


def fewest(hist, capacity):
    """Exact optimum of a small histogram, by trying what goes with the longest piece."""
    lengths = sorted(hist, reverse=True)

    @functools.cache
    def least(left):
        if not any(left):
            return 0
        first = next(i for i, n in enumerate(left) if n)

        def fill(i, room, now):
            if i == len(lengths):
                yield now
                return
            for k in range(min(now[i], room // lengths[i]) + 1):
                yield from fill(i + 1, room - k * lengths[i], (*now[:i], now[i] - k, *now[i + 1 :]))

        start = (*left[:first], left[first] - 1, *left[first + 1 :])
        return 1 + min(least(x) for x in fill(first, capacity - lengths[first], start))

    return least(tuple(hist[x] for x in lengths))


def test_plan_of_peaked_histograms():
    from gridspark.llm.packing import plan

    def sequences(hist, capacity):
        configs, seen = plan(hist, capacity), Counter()
        for c, n in configs.items():
            assert sum(k * v for k, v in c) <= capacity
            seen.update({k: v * n for k, v in c})
        assert seen == hist
        return sum(configs.values())

    assert sequences({1100: 1000, 512: 1000}, 2048) == 1000
    assert sequences({51: 600, 27: 600, 26: 600, 23: 1200}, 100) <= 1.02 * 900  # 900 full ones
    rng = np.random.default_rng(2)
    for _ in range(25):
        hist = {int(k): int(rng.integers(1, 6)) for k in rng.integers(8, 60, 4)}
        assert sequences(hist, 100) <= fewest(hist, 100) + 1
        # a hundred copies of a packing are a packing of a hundred copies
        assert sequences({k: 100 * n for k, n in hist.items()}, 100) <= 1.02 * 100 * fewest(hist, 100) + 1
    tail = {int(k): int(n) for k, n in zip(rng.integers(1, 2048, 900), rng.integers(1, 4, 900), strict=True)} | {1100: 40_000, 512: 40_000}
    assert sequences(tail, 2048) <= 1.02 * (40_000 + sum(n for k, n in tail.items() if k > 948 and k != 1100))


# ---- 6 ------------------------------------------------------------------------------------------


def test_language_id(spark, empty):
    from gridspark.llm.langid import Filters, held_out, language_id

    rng = random.Random(2)
    vocab = {"en": ["the", "and", "thing", "with", "ough"], "fr": ["été", "les", "eaux", "avec", "çois"]}
    rows = [(i, " ".join(rng.choice(vocab[x]) for _ in range(30)), x) for i, x in enumerate(["en", "fr"] * 60)]
    rows += [(500, None, "en"), (501, "", "fr"), (502, "123 !!", "en"), (None, "the and thing with", None), (503, "LES EAUX", None)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, score int")
    got = {r["doc_id"]: r for r in language_id(df, ["doc_id"]).select("doc.doc_id", held_out("doc.doc_id").alias("h"), "lang_pred", "score").collect()}
    assert all(got[i]["lang_pred"] == x for i, _, x in rows[:120]) and got[None]["lang_pred"] == "en" and got[503]["lang_pred"] == "fr"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (500, 501, 502))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and all(got[i]["h"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(120))
    assert language_id(empty, ["doc_id"]).count() == 0
    many = [f"l{i:02d}" for i in range(70)]  # more than one word of bits
    f = Filters(many, [np.arange(i * 10, i * 10 + 10) for i in range(70)])
    assert (f.masks(np.array([695]))[1] >> np.uint64(5)) & np.uint64(1) == 1


# ---- 7 ------------------------------------------------------------------------------------------


def cut(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[j : j + length] for j in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len([s for s in bytes(gone).split(b"\0") if s]), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("length, gram, crowd", [(400, 128, 1000), (100, 32, 1), (60, 60, 3)])
def test_repeats(docs, rows, length, gram, crowd):
    from gridspark.llm.repeats import deduplicated

    assert Counter(tuple(r) for r in deduplicated(docs, rule=("bytes", length, gram), crowd=crowd, bucket_bytes=20_000).collect()) == cut(rows, length)


def repeated_words(rows, length):
    """For each row the places of its words under `length` words that also stand elsewhere."""
    split = [[w for w in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode()) if w] for _, t in rows]
    seen = Counter(tuple(w[j : j + length]) for w in split for j in range(len(w) - length + 1))
    return [{j + k for j in range(len(w) - length + 1) if seen[tuple(w[j : j + length])] > 1 for k in range(length)} for w in split]


@pytest.mark.parametrize("length, gram, crowd", [(51, 20, 1000), (12, 5, 1)])
def test_repeated_words(docs, rows, length, gram, crowd):
    from gridspark.llm.repeats import cleaned, deduplicated

    rule, rng = ("words", length, gram), random.Random(3)
    words = prose(rng, 70).split()
    odd = [*rows, (900, " ".join(words)), (901, "a  " + "\n".join(words) + "\tz"), (902, "x" + " ".join(words[:-1]) + words[-1] + "s"), (903, "é " * 60), (904, "\0 " * 60)]
    inner = prose(rng, 60)
    odd += [(905, inner), (906, "x" + inner), (907, inner + "x")]  # the first word of 905 begins inside one of 906
    df = documents(docs.sparkSession, odd)
    want = repeated_words(odd, length)
    got = deduplicated(df, counted=(rule,), crowd=crowd, bucket_bytes=20_000).collect()
    assert Counter((r["doc_id"], r["n_repeated_words"]) for r in got) == Counter((i, len(x)) for (i, _), x in zip(odd, want, strict=True))
    assert Counter(tuple(r)[:-1] for r in got) == cut(odd, 400)
    left = {}
    for (i, t), gone in zip(odd, want, strict=True):
        kept = [w for k, w in enumerate(w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w) if k not in gone]
        if kept or not gone:
            left[i] = kept
    assert {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in cleaned(df, (rule,), crowd=crowd).collect()} == left


def test_long_texts_are_surveyed_in_parts(monkeypatch):
    from gridspark.llm import repeats as R

    rng = random.Random(5)
    raw = np.frombuffer(prose(rng, 4000).encode(), np.uint8)
    ends = np.array([0, len(raw)])
    rules = (("bytes", 100, 32), ("words", 12, 5))
    starts = lambda cols: {(int(k), x, int(m)) for k, lo, hi, m in zip(*cols[1:5], strict=True) for x in range(lo, hi + 1)}
    whole, counts = R.survey_windows(raw, ends, rules)
    monkeypatch.setattr(R, "PART_BYTES", 1000)
    parts, same = R.survey_windows(raw, ends, rules)
    assert starts(whole) == starts(parts) and len(parts[0]) > len(whole[0]) and [c.tolist() for c in counts] == [c.tolist() for c in same]


def test_repeats_edges(spark, empty):
    from gridspark.llm.repeats import cleaned, deduplicated

    assert deduplicated(empty).count() == 0
    rng = random.Random(9)
    a = prose(rng, 100)
    rows = [(1, a), (1, a), (None, a + "z"), (None, None), (2, "tail " + a[:405])]
    df = documents(spark, rows)
    assert Counter(tuple(r) for r in deduplicated(df).collect()) == cut(rows, 400)
    left = {r["doc_id"]: r["text"] for r in cleaned(df).collect()}
    assert left[2] == "tail " and 1 not in left
    kept = cleaned(documents(spark, [(4, ""), (5, None), (6, " \n"), (7, a), (8, a)])).collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {4: "", 5: None, 6: " \n"}


def test_spread_join(spark):
    from gridspark.llm.repeats import spread_join

    data = [(7, i) for i in range(3000)] + [(i % 50, 10_000 + i) for i in range(500)] + [(100 + i, i) for i in range(40)] + [(None, 1)]
    keys = Counter(m for m, _ in data if m is not None and m < 60)
    rows = spark.createDataFrame(data, "m long, row long")
    got = spread_join(rows, spark.createDataFrame(list(keys.items()), "m long, rows long"), "m", "row")
    assert sorted((r["m"], r["row"]) for r in got.collect()) == sorted(x for x in data if x[0] in keys)
    assert spread_join(rows, spark.createDataFrame([], "m long, rows long"), "m", "row").count() == 0


def test_fingerprints_tell_strings_apart():
    from gridspark.llm.common import prefix_hash, span_hash

    t, u = b"a", b"b"
    for _ in range(12):
        t, u = t + u, u + t  # Thue-Morse and its complement: equal in any polynomial of odd base modulo 2**64 over single bytes
    for size in (1024, 2048, 4096):
        text = np.frombuffer(t[:size] + u[:size], np.uint8)
        a, b = span_hash(prefix_hash(text), np.array([0, size]), np.array([size, 2 * size]))
        assert a != b
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 3000, dtype=np.uint8)
    data[2000:2600] = data[100:700]
    starts, sizes = rng.integers(0, 2900, 4000), rng.integers(0, 40, 4000)
    starts, sizes = np.append(starts, starts + 0), np.append(sizes, sizes + 1)
    ends = np.minimum(starts + sizes, 3000)
    marks = defaultdict(set)
    for s, e, h in zip(starts.tolist(), ends.tolist(), span_hash(prefix_hash(data), starts, ends).tolist(), strict=True):
        marks[data[s:e].tobytes()].add(h)
    assert all(len(x) == 1 for x in marks.values()) and len(set.union(*marks.values())) == len(marks)
    long_ = span_hash(prefix_hash(data), np.array([2000, 100, 2000]), np.array([2600, 700, 2599]))
    assert long_[0] == long_[1] != long_[2]


def test_run_index():
    from gridspark.llm.repeats import RunIndex, suffix_array

    rng = np.random.default_rng(4)
    for t in (b"banana" * 5, b"a" * 50, bytes(rng.integers(0, 3, 300, dtype=np.uint8)), b"x", b"ab" * 40 + b"\xff" + b"ab" * 40):
        v = np.frombuffer(t, np.uint8)
        assert suffix_array(v).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        want = [max([next((k for k in range(len(t)) if i + k >= len(t) or j + k >= len(t) or t[i + k] != t[j + k]), 0) for j in range(len(t)) if j != i], default=0) for i in range(len(t))]
        assert RunIndex(v).statistics().tolist() == want
    assert len(RunIndex(np.frombuffer(b"abcdefgh" * 200, np.uint8)).symbols) < 40  # few runs where text repeats


def test_statistics_of_a_least_size():
    from gridspark.llm.repeats import RunIndex

    rng = np.random.default_rng(8)
    for t in (b"banana" * 5, b"a" * 50, bytes(rng.integers(0, 3, 300, dtype=np.uint8)), b"x", b"", b"ab" * 40 + b"\xff" + b"ab" * 40, bytes(rng.integers(0, 2, 90, dtype=np.uint8)) * 3):
        index = RunIndex(np.frombuffer(t, np.uint8))
        whole = index.statistics()
        for least in (2, 5, 8, 9, 40, len(t) + 1):
            assert index.statistics(least).tolist() == np.where(whole >= least, whole, 0).tolist()


def test_index_measures_only_what_can_mark(monkeypatch):
    from gridspark.llm import repeats as R

    rng = random.Random(6)
    shared = prose(rng, 300)[:450]
    texts = [(prose(rng, 200)[:300] + (shared if i % 4 == 0 else "") + prose(rng, 300)[:500]).encode() for i in range(40)]
    done, real = [], R.span_hash
    monkeypatch.setattr(R, "span_hash", lambda prefix, a, b: done.append(len(a)) or real(prefix, a, b))
    got = R.repeats_in([(i, 0, 0, len(t) - 400, t, i == 4) for i, t in enumerate(texts)], "bytes", 400)
    seen = Counter(t[j : j + 400] for t in texts for j in range(len(t) - 399))
    want = {(i, j) for i, t in enumerate(texts) if i != 4 for j in range(len(t) - 399) if seen[t[j : j + 400]] > 1}
    assert want and {(i, j) for i, _, lo, hi in got for j in range(lo, hi + 1)} == want
    assert sum(done) < 4 * sum(map(len, texts))  # a full binary search takes over ten times the bytes
    assert R.repeats_in([(i, 0, 0, 50, texts[0][:450], True) for i in range(3)], "bytes", 400) == []


def test_survey_works_on_slices(monkeypatch):
    from gridspark.llm import repeats as R

    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(0, 400)).encode() for _ in range(60)] + [b"", prose(rng, 3000).encode(), b""]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    rules = (("bytes", 100, 32), ("words", 12, 5))
    whole, counts = R.survey_windows(data, ends, rules)
    monkeypatch.setattr(R, "SLICE_BYTES", 5000)
    sizes, real = [], R.windows_of
    monkeypatch.setattr(R, "windows_of", lambda text, *more: sizes.append(len(text)) or real(text, *more))
    cols, n = R.survey_slices(data, ends, rules)
    assert [c.tolist() for c in cols] == [c.tolist() for c in whole] and [c.tolist() for c in n] == [c.tolist() for c in counts]
    assert sorted(sizes)[-3] <= 5000 < sorted(sizes)[-2]  # only the long text, once for each rule, is larger


# ---- 8 ------------------------------------------------------------------------------------------


def test_sharding(spark, docs, empty):
    from gridspark.llm.sharding import sharded, write_shards

    few = docs.select("doc_id", "text")
    few = few.unionByName(few.where("doc_id = 3").crossJoin(spark.range(300).select())).unionByName(spark.createDataFrame([(None, None)] * 5, "doc_id long, text string"))
    out = sharded(few, 7, bucket_bytes=2000)
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(tuple(r) for r in few.collect())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 7
    again = sharded(few, 7, bucket_bytes=2000).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert sharded(few, 7, bucket_bytes=2000, seed=1).collect() != got
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert sharded(empty.select("doc_id"), 4).count() == 0


def test_shards_on_disk(spark, docs, tmp_path):
    from gridspark.llm.sharding import sharded, write_shards

    write_shards(sharded(docs.select("doc_id"), 3), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == 3


def test_shuffled_shards_hold_whole_documents(spark, docs, empty, tmp_path):
    from gridspark.llm.queries import op8_two_pass_shuffle
    from gridspark.llm.sharding import sharded, stored_shards

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    back = stored_shards(sharded(docs, 7, bucket_bytes=2000))
    assert back.columns == [*docs.columns, "shard", "slot"] and Counter(map(tuple, back.select(docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    assert len({f.split("shard=")[1].split("/")[0] for f in back.inputFiles()}) == 7
    out = op8_two_pass_shuffle(spark, str(tmp_path))
    assert out.inputFiles() and all("shard=" in f for f in out.inputFiles())  # read from shards
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out.collect()) == want
    plan = sharded(docs, 7, bucket_bytes=2000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1  # texts move once
    clash = docs.withColumns({"shard": F.lit("s"), "slot": F.lit(1), "position": F.lit(2), "doc": F.lit("d"), "h1": F.lit(None), "bucket": F.col("doc_id"), "m": F.create_map(F.lit("k"), F.col("doc_id"))})
    got = sharded(clash, 7, bucket_bytes=2000)
    assert got.columns == [*clash.columns, "shard_", "slot_"] and got.groupBy("shard_").count().count() == 7 and got.where("shard = 's' and h1 is null").count() == docs.count()
    assert stored_shards(sharded(empty, 4)).count() == 0


# ---- 9 ------------------------------------------------------------------------------------------


def test_targets():
    from gridspark.llm.mixing import targets

    assert targets([100, 100, 100], (1, 1, 1)) == [150, 150, 150]
    t = targets([10, 1000, 1000], (3, 1, 2))
    assert t[0] == 20 and abs(sum(t) - 3015) < 1e-9 and abs(t[2] / t[1] - 2) < 1e-9
    assert targets([0, 0]) == [0, 0] and targets([]) == []


def test_permutations():
    from gridspark.llm.mixing import _preimage, permuted, shard_counts

    for n in (1, 2, 3, 17, 100, 1025):
        for key in (np.uint64(1), np.uint64(2**63 + 5)):
            p = permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(p.tolist()) == list(range(n)) and all(p[_preimage(v, n, key)] == v for v in (0, n - 1, n // 2))
    d = shard_counts(np.array([1000, 10, 0, 333]), 9, 5)
    assert d.sum(axis=0).tolist() == [1000, 10, 0, 333] and np.ptp(d.sum(axis=1)) <= 1


def test_mixing(spark, docs, rows, empty):
    from gridspark.llm.mixing import remixed, taken, targets

    got = taken(docs, block_words=16).collect()
    size = lambda t: len((t or "").encode().split())
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t in rows)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    per, words = defaultdict(int), defaultdict(int)
    for r in got:
        per[source[r["doc_id"]]] += r["size"]
        words[source[r["doc_id"]]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    names = sorted(per, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, targets([per[s] for s in names]), strict=True))
    assert all(r["target"] == goal[source[r["doc_id"]]] and r["source_size"] == per[source[r["doc_id"]]] for r in got)
    assert all(abs(words[s] - goal[s]) <= 1 for s in names)
    assert sorted(map(str, got)) == sorted(map(str, taken(docs, block_words=16).collect()))
    assert taken(empty).count() == 0
    texts = remixed(docs, block_words=16)
    assert texts.columns == docs.columns
    made = defaultdict(int)
    for r in texts.collect():
        made[r["doc_id"]] += size(r["text"])
    assert {r["doc_id"]: r["taken"] for r in got if r["taken"]} == dict(made)
    assert remixed(empty).count() == 0


# ---- 10 -----------------------------------------------------------------------------------------


def test_importance_resampling(spark, docs, rows, empty):
    from gridspark.llm.quality import kth_largest, order_key, resampled

    rng = random.Random(3)
    good, bad = ["alpha", "beta", "gamma", "delta"], ["spam", "junk", "win", "click"]
    docs2 = spark.createDataFrame([(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(20)), 1) for i in range(200)] + [(500, None, 1), (501, "", 1), (None, "alpha", 1), (3, "alpha beta", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    out = resampled(docs2, labels, fraction=0.4).collect()
    assert len(out) == 204 and sum(r["selected"] for r in out) == round(0.4 * 204) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["doc_id"] % 2 for r in out if r["selected"] and r["doc_id"] is not None and r["doc_id"] < 200)
    assert {r["doc_id"]: r["selected"] for r in out} == {r["doc_id"]: r["selected"] for r in resampled(docs2, labels, fraction=0.4).collect()}
    keys = order_key(np.array([-1.5, 3.0, 0.0, -0.0, 1e300, -1e300, 2.5]))
    assert np.argsort(keys, kind="stable").tolist() == [5, 0, 2, 3, 6, 1, 4]
    df = spark.createDataFrame([(int(k),) for k in keys], "k long")
    assert [kth_largest(df, "k", i) for i in (1, 4, 7)] == [sorted(keys.tolist(), reverse=True)[i - 1] for i in (1, 4, 7)] and kth_largest(df, "k", 8) is None and kth_largest(df, "k", 0) is None
    assert resampled(empty, labels).count() == 0
    none = resampled(docs2, labels.where("false")).collect()
    assert {r["log_weight"] for r in none} == {0.0}


def test_importance_weights_by_brute_force(spark):
    import pyarrow as pa

    from gridspark.llm.quality import BITS, SEED, SMOOTH, ngram_buckets, resampled

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(WORDS[: 20 if i % 2 else 48]) for _ in range(rng.randint(0, 30)))) for i in range(120)] + [(500, None), (501, ""), (501, "")]
    good = [i for i in range(0, 120, 6)]
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(1, 1, 1), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    bucket = functools.cache(lambda *words: int(next(iter(ngram_buckets(pa.array([" ".join(words)]), BITS)))[0][-1]))  # of a word, or of the pair
    raw, target, grams = Counter(), Counter(), []
    for i, t in rows:
        w = (t or "").split()
        g = [bucket(x) for x in w] + [bucket(a, b) for a, b in zip(w, w[1:], strict=False)]
        grams.append(g)
        raw.update(g)
        target.update(g if i in good else [])
    n, total, own = 1 << BITS, sum(raw.values()), sum(target.values())
    base = lambda g: (raw[g] + 1) / (total + n)
    ratio = lambda g: np.log((target[g] + SMOOTH * base(g)) / (own + SMOOTH)) - np.log(base(g))
    want = [sum(ratio(x) for x in g) for g in grams]
    out = resampled(documents(spark, rows), labels, fraction=0.5).collect()
    got = defaultdict(list)
    for r in out:
        got[r["doc_id"]].append(r)
    for (i, _), w in zip(rows, want, strict=True):
        assert all(abs(r["log_weight"] - w) < 1e-6 for r in got[i])
    mask = (1 << 64) - 1

    def scramble(x):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = ((x ^ (x >> shift)) * by) & mask
        return x

    for r in out:
        u = (scramble((scramble(r["doc_id"]) + SEED) & mask) >> 11) * 2.0**-53 + 2.0**-54
        assert abs(r["sample_key"] - (r["log_weight"] - np.log(-np.log(u)))) < 1e-9
    least = sorted((r["sample_key"] for r in out), reverse=True)[round(0.5 * len(out)) - 1]
    assert all(r["selected"] == (r["sample_key"] >= least) for r in out)


def test_language_id_by_brute_force(spark):
    """Exact n-gram sets in place of the Bloom filters."""
    from gridspark.llm.langid import FLOOR, RATIO, held_out, language_id

    rng = random.Random(12)
    alphabets = {"aa": "abcdefgh", "bb": "efghijklm", "cc": "ñöéabmno"}
    word = lambda x: "".join(rng.choice(alphabets[x]) for _ in range(rng.randint(2, 7)))
    rows = [(i, " ".join(word(x) for _ in range(40)).capitalize() + ".", x) for i in range(240) for x in [("aa", "bb", "cc")[i % 3]]]
    grams = lambda t: ["".join(p if p.isalpha() else " " for p in (" " + t.lower() + " ")[k - 1 : k + 2]) for k in range(1, len(t) + 1) if t[k - 1].isalpha()]
    counts = {x: Counter() for x in alphabets}
    for i, t, x in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            counts[x].update(grams(t))
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    sets = {x: {g for g, p in share[x].items() if p >= FLOOR and p >= RATIO * max(s.get(g, 0) for s in share.values())} for x in share}
    df = spark.createDataFrame([(i, t, x) for i, t, x in rows], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id(df, ["doc_id"]).select("doc.doc_id", held_out("doc.doc_id").alias("h"), "lang_pred", "score").collect()}
    for i, t, x in rows:
        hits = {y: sum(g in sets[y] for g in grams(t)) / len(grams(t)) for y in sets}
        best = max(hits, key=hits.get)
        assert got[i]["lang_pred"] == best == x and abs(got[i]["score"] - hits[best]) < 0.03
    assert 20 < sum(r["h"] for r in got.values()) < 120


def test_queries_return_what_they_promise(spark, rows, tmp_path):
    """Every query on tables on disk, and the columns it derives, against plain Python."""
    from gridspark.llm.mixing import targets
    from gridspark.llm.queries import QUERIES

    many = [r for r in rows if r[0] is not None][:70]
    docs = documents(spark, many)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(i, [float(i % 7), 0.5, -1.0]) for i in range(60)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = {name: f(spark, str(tmp_path)) for name, f in QUERIES.items()}
    types = {name: dict(df.dtypes) for name, df in out.items()}
    assert types["op1_exact_topk"] | {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"} == types["op1_exact_topk"]
    long_ = lambda *names: dict.fromkeys(names, "bigint")
    asked = {
        "op3_gif_columns": long_("doc_id", "n_bytes", "payload_bytes", "tail_crc32", "media_bytes") | dict.fromkeys(("payload_sha256", "media_sha256", "feature"), "string"),
        "op4_minhash_neardup": long_("doc_id", "n_shingles", "component_id") | {"kept": "boolean"},
        "op5_config_lp_packing": long_("doc_id", "start", "length", "ids_crc32", "sequence_id", "offset") | {"piece": "int"},
        "op6_bitmask_langid": long_("doc_id") | {"held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op7_run_index_dedup": long_("doc_id", "n_bytes", "n_removed", "n_spans", "n_repeated_words") | {"kept_sha256": "string"},
        "op8_two_pass_shuffle": long_("doc_id", "size", "text_crc32", "slot") | {"law": "string", "shard": "int", "grown_shard": "int"},
        "op9_source_mix": long_("doc_id", "size", "source_size", "taken") | {"target": "double"},
    }
    for name, want in asked.items():
        assert types[name] | want == types[name], name
    got = {name: {r["doc_id"]: r for r in out[name].collect()} for name in asked if name != "op5_config_lp_packing"}
    raw = {i: (t or "").encode() for i, t in many}
    for i, b in raw.items():
        padded = b + b"\xff" * (-len(b) % 576 if b else 576)
        m = got["op3_gif_columns"][i]
        assert (m["n_bytes"], m["payload_bytes"], m["payload_sha256"], m["tail_crc32"]) == (len(b), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert got["op6_bitmask_langid"][i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert (got["op8_two_pass_shuffle"][i]["size"], got["op8_two_pass_shuffle"][i]["text_crc32"]) == (len(b) + 16, zlib.crc32(b))
    size = {i: len(re.findall(rb"[^\x20\x09-\x0D]+", b)) for i, b in raw.items()}
    source = {i: (None, "a", "b", "hot", "hot")[i % 5] for i in raw}
    order = ["a", "b", "hot", None]
    sums = [sum(size[i] for i in raw if source[i] == s) for s in order]
    goal = dict(zip(order, targets(sums), strict=True))
    for i, r in got["op9_source_mix"].items():
        assert (r["size"], r["source_size"]) == (size[i], sums[order.index(source[i])]) and abs(r["target"] - goal[source[i]]) < 1e-6 and r["taken"] <= 2 * r["size"]
    slots = defaultdict(list)
    for r in got["op8_two_pass_shuffle"].values():
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(40)) and all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert out["op10_importance_resampling"].count() == out["op2_licence_digest"].count() == len(many)
    equal = defaultdict(set)  # equal texts, equal media
    for i, b in raw.items():
        equal[b].add((got["op3_gif_columns"][i]["media_sha256"], got["op3_gif_columns"][i]["feature"]))
    assert all(len(x) == 1 for x in equal.values())


# ---- pipeline -----------------------------------------------------------------------------------


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline as P

    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{i}"))
        docs = spark.read.parquet(str(tmp_path / f"{i}"))
        if i < 4:
            assert docs.columns == names, name
    assert docs.count() == P.run(spark, str(tmp_path)).count() > 0
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_pipeline_keeps_the_ids_of_every_copy(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as P

    rng = random.Random(4)
    rows = [(1, prose(rng, 3000)), (1, prose(rng, 50)), (2, "ka lo"), (2, "ka lo"), (None, prose(rng, 9)), (3, None)]
    out = P.pack(spark, documents(spark, rows), "").collect()
    made = defaultdict(list)
    for r in out:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        made[(r["doc_id"], r["copy"])].append((r["piece"], bytes(r["ids"])))
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, x in rows)
    assert Counter((i, b"".join(x for _, x in sorted(parts))) for (i, _), parts in made.items()) == want
    assert all([k for k, _ in sorted(parts)] == list(range(len(parts))) for parts in made.values())


def test_pipeline_on_nothing(spark, empty, tmp_path):
    import corpus_pipeline as P

    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_rows_pass_the_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(8)
    rows = [(1, prose(rng, 60)), (None, prose(rng, 60)), (2, None), (3, prose(rng, 60))]
    documents(spark, [*rows, rows[0], rows[3]]).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"] for r in P.run(spark, str(tmp_path)).collect()} >= {1, 3}


#: Every name that an operator of the pipeline uses for a column of its own.
INNER = "doc row rows runs h1 h2 d1 d2 digest lang_pred score label gram n all top size s start cell source_size target taken slot shard epoch words lo hi block base inner w rid k m id need rep copied gone some sha n_bytes windows component kept n_shingles sketch vals v f comp c a b position first bucket task bytes copies again red green blue gif width height frame samples histograms ids piece length offset sequence_id _rank _task _nth _base".split()


@pytest.mark.parametrize("step", range(5))
def test_pipeline_keeps_columns_of_any_name(spark, rows, tmp_path, step):
    import corpus_pipeline as P

    names = [x for x in INNER if x not in ("id", "v", "n")]
    docs = documents(spark, rows[:60]).select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(f"of {x}").alias(x) for x in names))
    name, stage = P.STAGES[step]
    out = stage(spark, docs, str(tmp_path))
    if step == 4:
        assert out.count() > 0
        return
    assert out.columns == docs.columns, name
    got = out.collect()
    assert got and all(r[x] == f"of {x}" for r in got for x in names), name


def test_a_copy_without_id_goes_with_near_duplicates(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(8)
    a, b = prose(rng, 100), prose(rng, 100)
    docs = documents(spark, [(1, a), (None, a), (None, b), (None, b), (None, None), (2, "")])
    kept = P.keep_one_of_each_group(spark, docs, str(tmp_path))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, a), (None, b), (None, None), (2, "")])
    assert {r["text"] for r in P.cut_repeats(spark, kept, str(tmp_path)).collect()} >= {a, b}


def test_texts_in_no_learnt_language_go(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(31)
    docs = documents(spark, [(i, prose(rng, 60)) for i in range(90)] + [(200, "Съешь ещё этих мягких французских булок"), (203, "日本語の文章です。これは試験です。"), (206, "xjq zzv wpq fgh bbq yyx"), (209, None), (212, "12 34")])  # without labels
    assert {r["doc_id"] for r in P.keep_identified(spark, docs, str(tmp_path)).collect()} == set(range(90))

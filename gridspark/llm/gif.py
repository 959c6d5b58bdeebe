"""Media columns: GIF files in a binary column, decoded to timed frames with colour-histogram columns.

Decoding follows GIF89a: colour tables (global or a frame's own), interlacing, frame offsets, transparency, the disposal
methods (keep, restore to background, restore to previous) and LZW code streams of any minimum code size.  The LZW codes
of many frames are expanded together: code widths depend on a code's number since the last clear code only, an entry
is a copy of earlier output, and copies resolve to literals by pointer jumping.  Streams with further clear codes go
through the plain decoder.

Encoding packs bytes losslessly into 24 x 24 frames of 256 grey levels, one sample a byte.

Defined cases: null or empty media, or media without frames, give no frames and empty samples; a truncated stream gives
the pixels that it holds, the rest 0; a file that isn't a GIF gives null columns.  Repeated rows, nulls in other columns
and extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import text_buffer

SIDE = 24
FRAME = SIDE * SIDE
DELAY_CS, BINS, CHUNK = 10, 16, 1 << 19
_GREY = bytes(v for i in range(256) for v in (i, i, i))


# ---- LZW ----------------------------------------------------------------------------------------


def code_widths(n: int, min_code: int) -> np.ndarray:
    """Width in bits of code 0 .. n-1 after a clear code."""
    entries = np.arange(n) + (1 << min_code) + 1  # table size, less one, when the code is read
    return np.clip(np.ceil(np.log2(entries + 1)).astype(np.int64), min_code + 1, 12)


def lzw_codes(data: bytes, min_code: int = 8) -> list[int]:
    """Codes of data, from the first clear code to the end code."""
    clear = 1 << min_code
    out, known, fresh = [clear], {}, clear + 2
    get = known.get
    it = iter(data)
    now = next(it, None)
    if now is None:
        return [clear, clear + 1]
    put = out.append
    for b in it:
        key = now << 8 | b
        code = get(key)
        if code is None:
            put(now)
            known[key] = fresh
            fresh += 1
            now = b
            if fresh > 4095:
                put(clear)
                known.clear()
                fresh = clear + 2
        else:
            now = code
    out += [now, clear + 1]
    return out


def lzw_decode(data: bytes, min_code: int, most: int) -> np.ndarray:
    """Plain decoder: at most `most` pixels."""
    clear = 1 << min_code
    out, table, width, acc, bits, last = bytearray(), [], min_code + 1, 0, 0, None
    for byte in data:
        acc |= byte << bits
        bits += 8
        while bits >= width:
            code = acc & ((1 << width) - 1)
            acc >>= width
            bits -= width
            if code == clear:
                table, width, last = [bytes([i & 255]) for i in range(clear)] + [b"", b""], min_code + 1, None
                continue
            if code == clear + 1 or len(out) >= most:
                return np.frombuffer(bytes(out[:most]), np.uint8)
            if not table:
                table = [bytes([i & 255]) for i in range(clear)] + [b"", b""]
            if code < len(table):
                text = table[code]
            elif last is not None:
                text = last + last[:1]
            else:
                return np.frombuffer(bytes(out[:most]), np.uint8)
            out += text
            if last is not None and len(table) < 4096:
                table.append(last + text[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = text
    return np.frombuffer(bytes(out[:most]), np.uint8)


def pack_codes(streams: list[list[int]], min_code: int = 8) -> list[bytes]:
    """Bit-packed code streams (each begins with a clear code)."""
    counts = np.array([len(s) for s in streams])
    codes = np.fromiter((c for s in streams for c in s), np.int64, int(counts.sum()))
    first = np.cumsum(counts) - counts
    number = np.arange(len(codes)) - np.repeat(first, counts)  # 0 is the clear code itself
    since = np.arange(len(codes)) - np.maximum.accumulate(np.where(codes == 1 << min_code, np.arange(len(codes)), 0)) - 1
    table = code_widths(4200, min_code)
    width = np.where(since < 0, 0, table[np.clip(since, 0, 4199)])
    at_clear = np.flatnonzero(since < 0)
    width[at_clear] = np.where(number[at_clear] == 0, min_code + 1, np.clip(np.concatenate([[0], width])[at_clear], min_code + 1, 12))
    end = np.cumsum(width)
    bit = end - width
    start_bit = bit[first]
    n_bytes = -(-(np.append(start_bit[1:], end[-1]) - start_bit) // 8)
    base = np.cumsum(n_bytes) - n_bytes
    place = bit - np.repeat(start_bit, counts) + np.repeat(base, counts) * 8
    value = codes << (place & 7)
    total = int(n_bytes.sum())
    byte = place >> 3
    flat = sum(np.bincount(byte + k, (value >> (8 * k)) & 255, total + 3) for k in range(3))[:total].astype(np.uint8).tobytes()
    return [flat[a : a + n] for a, n in zip(base.tolist(), n_bytes.tolist(), strict=True)]


def lzw_decode_many(streams: list[bytes], min_code: int, pixels: int) -> np.ndarray:
    """(len(streams), pixels): all streams at once, as far as each has one leading clear code only."""
    out = np.zeros((len(streams), pixels), np.uint8)
    if not streams:
        return out
    clear, n = 1 << min_code, len(streams)
    size = max(len(s) for s in streams) + 3
    raw = np.frombuffer(b"".join(s.ljust(size, b"\0") for s in streams), np.uint8).reshape(n, size).astype(np.int32)
    widths = np.concatenate([[min_code + 1], code_widths(min(pixels + 1, 8 * size), min_code)])
    bit = np.cumsum(widths) - widths
    use = bit + widths <= 8 * size
    widths, bit = widths[use], bit[use]
    b = np.minimum(bit >> 3, size - 3)
    codes = ((raw[:, b] | raw[:, b + 1] << 8 | raw[:, b + 2] << 16) >> (bit & 7)) & ((1 << widths) - 1)
    have = np.array([8 * len(s) for s in streams])
    codes = np.where(bit + widths > have[:, None], clear + 1, codes)
    plain = (codes[:, 0] == clear) & ~(codes[:, 1:] == clear).any(axis=1)
    codes = codes[:, 1:]
    ended = np.where((codes == clear + 1).any(axis=1), np.argmax(codes == clear + 1, axis=1), codes.shape[1])
    live = np.arange(codes.shape[1]) < ended[:, None]
    entry = codes - clear - 2
    known = (entry < np.arange(codes.shape[1])) | ~live  # an entry is there once its code has been read
    plain &= known.all(axis=1)
    lengths = np.where(live, 1, 0)
    rows = np.arange(n)
    is_entry = live & (entry >= 0)
    for j in np.flatnonzero(is_entry.any(axis=0)).tolist():
        e = np.clip(entry[:, j], 0, j - 1 if j else 0)
        lengths[:, j] = np.where(is_entry[:, j], lengths[rows, e] + 1, lengths[:, j])
    start = np.cumsum(lengths, axis=1) - lengths
    good = np.flatnonzero(plain)
    if len(good):
        lens, total = lengths[good], lengths[good].sum(axis=1)
        width = int(total.max(initial=0))
        base = np.arange(len(good))[:, None] * width
        flat_len = lens.ravel()
        at = np.repeat((start[good] + base).ravel(), flat_len)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(flat_len) - flat_len, flat_len)
        code_entry = entry[good]
        source = np.where(code_entry >= 0, np.take_along_axis(start[good], np.clip(code_entry, 0, None), 1) + base, -1)
        src = np.repeat(source.ravel(), flat_len)
        pointer = np.zeros(len(good) * width, np.int64)
        value = np.zeros(len(good) * width, np.uint8)
        where = at + inside
        pointer[where] = np.where(src >= 0, src + inside, where)
        value[where] = np.where(src >= 0, 0, np.repeat(codes[good].ravel(), flat_len)).astype(np.uint8)
        pointer_next = pointer[pointer]
        while not np.array_equal(pointer_next, pointer):
            pointer = pointer_next
            pointer_next = pointer[pointer]
        found = value[pointer].reshape(len(good), width)[:, :pixels]
        found = np.where(np.arange(found.shape[1]) < total[:, None], found, 0)
        out[good, : found.shape[1]] = found
    for i in np.flatnonzero(~plain).tolist():
        got = lzw_decode(streams[i], min_code, pixels)
        out[i, : len(got)] = got
    return out


# ---- the container ------------------------------------------------------------------------------


def encode_grey(payloads: list[bytes], delay_cs: int = DELAY_CS) -> list[bytes]:
    """A GIF for each payload (a multiple of FRAME bytes), FRAME bytes a frame."""
    packed = pack_codes([lzw_codes(p[i : i + FRAME]) for p in payloads for i in range(0, len(p), FRAME)])
    head = b"GIF89a" + SIDE.to_bytes(2, "little") * 2 + b"\xf7\0\0" + _GREY
    before = b"\x21\xf9\x04\x04" + delay_cs.to_bytes(2, "little") + b"\0\0\x2c\0\0\0\0" + SIDE.to_bytes(2, "little") * 2 + b"\0\x08"
    out, k = [], 0
    for p in payloads:
        parts = [head]
        for _ in range(len(p) // FRAME):
            parts.append(before)
            s = packed[k]
            k += 1
            for i in range(0, len(s), 255):
                block = s[i : i + 255]
                parts += (bytes([len(block)]), block)
            parts.append(b"\0")
        parts.append(b";")
        out.append(b"".join(parts))
    return out


def parse(raw: bytes) -> tuple[int, int, list[dict]] | None:
    """(width, height, frames) of a GIF, LZW data not yet expanded; None for anything else."""
    if raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        return None
    width, height, flags = int.from_bytes(raw[6:8], "little"), int.from_bytes(raw[8:10], "little"), raw[10]
    at, colours, frames = 13, None, []
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        colours, at = raw[at : at + n], at + n
    delay, disposal, clear = 0, 0, None
    while at < len(raw) and raw[at] != 0x3B:
        if raw[at] == 0x21:
            if raw[at + 1 : at + 3] == b"\xf9\x04" and at + 8 <= len(raw):
                f = raw[at + 3]
                delay, disposal, clear = int.from_bytes(raw[at + 4 : at + 6], "little"), f >> 2 & 7, raw[at + 6] if f & 1 else None
            at += 2
        elif raw[at] == 0x2C and at + 11 <= len(raw):
            x, y, w, h = (int.from_bytes(raw[at + i : at + i + 2], "little") for i in (1, 3, 5, 7))
            f, at, own = raw[at + 9], at + 10, colours
            if f & 0x80:
                n = 3 << ((f & 7) + 1)
                own, at = raw[at : at + n], at + n
            code, at = raw[at] if at < len(raw) else 8, at + 1
            frames.append({"x": x, "y": y, "w": w, "h": h, "colours": own, "interlaced": bool(f & 0x40), "min_code": code, "delay": delay, "disposal": disposal, "clear": clear})
            delay, disposal, clear = 0, 0, None
            data = []
            while at < len(raw) and raw[at]:
                data.append(raw[at + 1 : at + 1 + raw[at]])
                at += raw[at] + 1
            at += 1
            frames[-1]["data"] = b"".join(data)
            continue
        else:
            break
        while at < len(raw) and raw[at]:
            at += raw[at] + 1
        at += 1
    return width, height, frames


def _deinterlace(px: np.ndarray) -> np.ndarray:
    h = len(px)
    rows = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
    out = np.empty_like(px)
    out[rows] = px
    return out


def composed(width: int, height: int, frames: list[dict], pixels: list[np.ndarray]) -> np.ndarray:
    """(frames, height, width, 3): what is shown at each frame; background and unset pixels are black."""
    canvas = np.zeros((height, width, 3), np.uint8)
    out = np.empty((len(frames), height, width, 3), np.uint8)
    for k, (f, px) in enumerate(zip(frames, pixels, strict=True)):
        table = np.zeros((256, 3), np.uint8)
        if f["colours"]:
            c = np.frombuffer(f["colours"][: len(f["colours"]) // 3 * 3], np.uint8).reshape(-1, 3)
            table[: len(c)] = c
        px = px.reshape(f["h"], f["w"])
        if f["interlaced"]:
            px = _deinterlace(px)
        before = canvas.copy() if f["disposal"] == 3 else None
        y, x = slice(f["y"], min(f["y"] + f["h"], height)), slice(f["x"], min(f["x"] + f["w"], width))
        part = px[: max(0, y.stop - f["y"]), : max(0, x.stop - f["x"])]
        shown = np.ones(part.shape, bool) if f["clear"] is None else part != f["clear"]
        if part.size:
            canvas[y, x][shown] = table[part[shown]]
        out[k] = canvas
        if f["disposal"] == 2 and part.size:
            canvas[y, x] = 0
        elif before is not None:
            canvas = before
    return out


def luma(rgb: np.ndarray) -> np.ndarray:
    """Of samples with the channels first."""
    return ((299 * rgb[0].astype(np.uint32) + 587 * rgb[1].astype(np.uint32) + 114 * rgb[2].astype(np.uint32)) // 1000).astype(np.uint8)


def decode_many(files: list[bytes | None]) -> list[tuple | None]:
    """(width, height, delays in ms, (channels, frames, height, width) red, green and blue samples) of each file."""
    parsed = [parse(x) if x else None for x in files]
    groups: dict[tuple[int, int], list[dict]] = {}
    for p in parsed:
        for f in p[2] if p else ():
            groups.setdefault((f["min_code"], f["w"] * f["h"]), []).append(f)
    for (code, n), frames in groups.items():
        fine = 1 <= code <= 8
        px = lzw_decode_many([f["data"] for f in frames], code, n) if fine else np.zeros((len(frames), n), np.uint8)
        for i, f in enumerate(frames):
            f["at"], f["all"] = i, px
    out: list[tuple | None] = []
    for p in parsed:
        if p is None:
            out.append(None)
            continue
        width, height, frames = p
        simple = frames and all(f["colours"] is frames[0]["colours"] and f["all"] is frames[0]["all"] and f["clear"] is None and f["disposal"] < 2 and not f["interlaced"] and (f["x"], f["y"], f["w"], f["h"]) == (0, 0, width, height) for f in frames)
        if simple and len(frames[0]["colours"] or b"") == 768:  # every frame replaces the whole picture
            table = np.frombuffer(frames[0]["colours"], np.uint8).reshape(-1, 3).T
            a = frames[0]["at"]
            samples = table[:, frames[0]["all"][a : a + len(frames)]].reshape(3, len(frames), height, width)
        else:
            samples = np.moveaxis(composed(width, height, frames, [f["all"][f["at"]] for f in frames]), 3, 0)
        out.append((width, height, [f["delay"] * 10 for f in frames], samples))
    return out


# ---- columns ------------------------------------------------------------------------------------


def _chunks(sizes: np.ndarray):
    lo, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and total + n > CHUNK:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", delay_cs: int = DELAY_CS) -> DataFrame:
    """(doc_id, n_bytes, gif): every text's UTF-8 bytes, filled with bytes 255 to whole frames, as a GIF."""

    def work(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in _chunks(np.diff(offsets)):
                raws = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(lo, hi)]
                files = encode_grey([r + b"\xff" * (max(1, -(-len(r) // FRAME)) * FRAME - len(r)) for r in raws], delay_cs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(r) for r in raws], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "gif"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, n_bytes long, gif binary")


def _binned(samples: np.ndarray) -> np.ndarray:
    """(frames, BINS): for each frame of samples its pixels in each of BINS equal ranges."""
    n = len(samples)
    flat = (np.arange(n)[:, None] * BINS + (samples.reshape(n, -1).astype(np.int64) * BINS >> 8)).ravel() if samples.size else np.zeros(0, np.int64)
    return np.bincount(flat, minlength=n * BINS).reshape(n, BINS)


def media_columns(media: DataFrame, gif_col: str = "gif") -> DataFrame:
    """media with width, height, red, green and blue (all frames' samples of a channel, one after another), starts_ms,
    delays_ms and colour_histograms (for each frame the pixel counts of BINS equal ranges of red, then of green, then of blue);
    samples and histograms are those of the frames' luma."""
    names = media.columns
    made = ["width", "height", "samples", "starts_ms", "delays_ms", "histograms", "red", "green", "blue", "colour_histograms"]

    def work(batches):
        for batch in batches:
            sizes = pc_lengths(batch.column(gif_col))
            for lo, hi in _chunks(sizes):
                part = batch.slice(lo, hi - lo)
                cols: list[list] = [[] for _ in made]
                for d in decode_many(part.column(gif_col).to_pylist()):
                    if d is None:
                        row = (None,) * len(made)
                    else:
                        w, h, delays, rgb = d
                        grey = luma(rgb)
                        channels = [x.tobytes() for x in rgb]
                        row = (w, h, grey.tobytes(), (np.cumsum([0, *delays])[:-1]).tolist(), delays, _binned(grey).tolist(), *channels, np.concatenate([_binned(x) for x in rgb], axis=1).tolist())
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                counts = pa.list_(pa.list_(pa.int32()))
                types = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), counts, pa.binary(), pa.binary(), pa.binary(), counts]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [*names, *made])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInArrow(work, schema + ", width int, height int, samples binary, starts_ms array<long>, delays_ms array<int>, histograms array<array<int>>, red binary, green binary, blue binary, colour_histograms array<array<int>>")


def pc_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def timed_frames(columns: DataFrame, *keep: str) -> DataFrame:
    """One row per frame: the kept columns, frame, start_ms, delay_ms, pixels and histogram (luma), red, green, blue and
    colour_histogram."""
    size = F.col("width") * F.col("height")
    planes = ("samples", "red", "green", "blue")
    each = columns.select(*keep, *planes, "width", "height", F.posexplode(F.arrays_zip("starts_ms", "delays_ms", "histograms", "colour_histograms")).alias("frame", "x"))
    pixels, red, green, blue = (F.substring(c, F.col("frame") * size + 1, size).alias("pixels" if c == "samples" else c) for c in planes)
    return each.select(*keep, "frame", F.col("x.starts_ms").alias("start_ms"), F.col("x.delays_ms").alias("delay_ms"), pixels, F.col("x.histograms").alias("histogram"), red, green, blue, F.col("x.colour_histograms").alias("colour_histogram"))

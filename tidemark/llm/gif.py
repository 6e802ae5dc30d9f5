"""GIF images as media columns.

Reads and writes GIF89a: LZW code streams, global and local palettes, interlacing,
frame disposal and transparency.  Frames are stored as timed rows with colour-histogram
columns.  Any bytes can be stored losslessly as the colour indices of an image.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 192
FRAME_ROWS = 512
BINS = 64
#: Bytes of results that a worker holds before it passes them on.
HELD = 8 << 20
#: Colour index i stands for red i >> 5, green (i >> 2) & 7 and blue i & 3, each spread over 0 to 255.
PALETTE = np.array([((i >> 5) * 255 // 7, ((i >> 2) & 7) * 255 // 7, (i & 3) * 85) for i in range(256)], np.uint8)

FRAME = "frame int, at_ms long, delay_ms int, left int, top int, width int, height int, disposal int, transparent int, histogram array<long>, own_histogram array<long>"


class GifError(ValueError):
    pass


#: By code size, what ``_widths`` has worked out in this process.
_WIDTHS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _widths(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the k-th code after a clear code, while the table of codes grows, and of all codes before it."""
    if bits in _WIDTHS:
        return _WIDTHS[bits]
    k = np.arange((1 << 12) + 2)
    nxt = (1 << bits) + 1 + np.maximum(k, 1)
    widths = np.minimum(12, np.maximum(bits + 1, np.floor(np.log2(nxt)).astype(int) + 1))
    _WIDTHS[bits] = widths, np.cumsum(widths) - widths
    return _WIDTHS[bits]


def lzw_encode(data: bytes, bits: int = 8, compress: bool = True) -> bytes:
    """Variable-width LZW codes of the data, least significant bit first.

    Without ``compress`` every index is a code of its own and the table is cleared before
    codes widen: about an eighth larger than the data, but made at the speed of numpy.
    """
    clear, end = 1 << bits, (1 << bits) + 1
    widths, _ = _widths(bits)
    if not compress:
        run = clear - 2
        values = np.frombuffer(data, np.uint8).astype(np.int64)
        whole = len(values) // run * run
        rows = np.hstack([values[:whole].reshape(-1, run), np.full((whole // run, 1), clear)]).ravel()
        values = np.concatenate([[clear], rows, values[whole:], [end]])
        return _pack(values, np.full(len(values), bits + 1))
    segments: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    get, add = table.get, codes.append
    size, full = end + 1, 1 << 12
    at = iter(data)
    prefix = next(at, None)
    if prefix is not None:
        for byte in at:
            key = prefix << 8 | byte
            code = get(key)
            if code is not None:
                prefix = code
                continue
            add(prefix)
            prefix = byte
            table[key] = size
            size += 1
            if size == full:
                add(clear)
                segments.append(codes)
                codes, size = [], end + 1
                add = codes.append
                table.clear()
        add(prefix)
    add(end)
    segments.append(codes)
    values = np.concatenate([np.array([clear])] + [np.array(s) for s in segments])
    return _pack(values, np.concatenate([widths[:1]] + [widths[: len(s)] for s in segments]))


def _pack(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Codes of the given sizes in bits, one after the other; whole bytes at a time to bound memory."""
    out, place, step = [], np.arange(12), 1 << 17
    for i in range(0, len(values), step):
        grid = (values[i : i + step, None] >> place).astype(np.uint8) & 1
        out.append(grid[place < sizes[i : i + step, None]])
    return np.packbits(np.concatenate(out), bitorder="little").tobytes()


def _strings(codes: np.ndarray, clear: int, room: int) -> np.ndarray:
    """The indices that the codes since a clear code stand for.

    The k-th code adds an entry: its own string and the first index of the next code's.
    So a code that names entry j continues the string of code j; chains of codes are
    followed for all codes at once, from the last index of each string to the first.
    """
    n = len(codes)
    literal = codes < clear
    if literal.all():
        return codes.astype(np.uint8)
    own = np.arange(n)
    parent = np.where(literal, own, codes - clear - 2)
    if (~literal & ((parent >= np.minimum(own, room)) | (parent < 0))).any():
        raise GifError("code beyond the table")
    root, length, up = parent.copy(), np.where(literal, 0, 1), parent.copy()
    while True:  # doubling: each round follows twice as many links
        further = length + length[up]
        root = root[root]
        if (further == length).all():
            break
        length, up = further, up[up]
    first = codes[root]
    last = np.where(literal, codes, first[np.minimum(parent + 1, n - 1)])
    ends = np.cumsum(length + 1)
    out = np.empty(int(ends[-1]), np.uint8)
    at, now = ends - 1, own
    while len(now):
        out[at] = last[now]
        on = ~literal[now]
        at, now = at[on] - 1, parent[now[on]]
    return out


def lzw_decode(stream: bytes, bits: int, wanted: int) -> bytes:
    """Up to ``wanted`` colour indices.

    The widths of codes depend only on how many came since the last clear code, so that
    runs of codes are cut from the stream at once.  A table that is full stays as it is
    until a clear code.
    """
    if not 1 <= bits <= 11:
        raise GifError("code size")
    clear, end = 1 << bits, (1 << bits) + 1
    widths, offsets = _widths(bits)
    data = np.frombuffer(stream + b"\0\0\0\0", np.uint8)
    limit = len(stream) * 8
    out: list[np.ndarray] = []
    done, bit, since, ended = 0, 0, 0, False
    epoch: list[np.ndarray] = []
    few = 512
    while done < wanted and not ended:
        # codes `since` and on of this table, while their widths grow; 12 bits beyond
        if since < len(widths):
            size = widths[since : since + few]
            where = bit + offsets[since : since + few] - offsets[since]
        else:
            size = np.full(few, 12)
            where = bit + 12 * np.arange(few)
        fits = int(np.searchsorted(where + size, limit, "right"))
        where, size = where[:fits], size[:fits]
        byte = where >> 3
        word = data[byte].astype(np.int64) | data[byte + 1].astype(np.int64) << 8 | data[byte + 2].astype(np.int64) << 16
        codes = (word >> (where & 7)) & ((1 << size) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else len(codes)
        epoch.append(codes[:n])
        since += n
        ended = not fits or len(stop) > 0 and codes[n] == end
        few = 512 if len(stop) else min(4 * few, 1 << 16)
        if n < len(codes):
            bit = int(where[n] + size[n])
        elif fits:
            bit = int(where[-1] + size[-1])
        # nothing is left to read, the table is cleared, or there are enough codes
        if ended or len(stop) or done + since >= wanted:
            some = _strings(np.concatenate(epoch)[: wanted - done], clear, (1 << 12) - end - 1)
            out.append(some)
            done += len(some)
            epoch, since = [], 0
    return np.concatenate(out)[:wanted].tobytes() if out else b""


@dataclass
class Frame:
    """One image: its indices as stored, and the canvas as shown, with red, green, blue and opacity."""

    at_ms: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    transparent: int
    indices: bytes
    canvas: np.ndarray
    #: The frame's own pixels alone, in colour, those that it leaves out transparent.
    own: np.ndarray


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def read_gif(data: bytes, max_pixels: int = 1 << 28) -> Iterator[Frame]:
    """The frames of a GIF, each as shown after it is drawn; ``GifError`` on what cannot be read.

    A screen of more than ``max_pixels`` is refused: a few bytes can ask for any canvas.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no GIF header")
    width, height, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    if width * height > max_pixels:
        raise GifError("screen too large")
    at = 13
    palette = None
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette = np.frombuffer(data[at : at + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, transparent, time = 0, 0, -1, 0
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, hundredths, index = struct.unpack("<BHB", body[:4])
                delay, disposal, transparent = hundredths * 10, packed >> 2 & 7, index if packed & 1 else -1
            continue
        if kind != 0x2C or at + 11 > len(data):
            raise GifError("unknown block")
        left, top, w, h, packed = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        colours = palette
        if packed & 0x80:
            n = 2 << (packed & 7)
            colours = np.frombuffer(data[at : at + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(n, 3)
            at += 3 * n
        if colours is None:
            raise GifError("no palette")
        if at >= len(data) or w * h > max_pixels:
            raise GifError("no image data")
        bits = data[at]
        stream, at = _blocks(data, at + 1)
        indices = lzw_decode(stream, bits, w * h)
        if len(indices) < w * h:
            raise GifError("image data ends early")
        grid = np.frombuffer(indices, np.uint8).reshape(h, w)
        if packed & 0x40:  # interlaced: rows come in four passes
            order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
            rows = np.empty_like(grid)
            rows[order] = grid
            grid = rows
        before = canvas.copy() if disposal == 3 else None
        seen = canvas[top : top + h, left : left + w]
        part = grid[: seen.shape[0], : seen.shape[1]]
        drawn = part != transparent if transparent >= 0 else np.ones(part.shape, bool)
        full = np.zeros((256, 3), np.uint8)
        full[: len(colours)] = colours
        seen[..., :3] = np.where(drawn[..., None], full[part], seen[..., :3])
        seen[..., 3] = np.where(drawn, 255, seen[..., 3])
        own = np.concatenate([full[grid], np.where(grid == transparent, 0, 255)[..., None].astype(np.uint8)], axis=2)
        yield Frame(time, delay, left, top, w, h, disposal, transparent, grid.tobytes(), canvas.copy(), own)
        time += delay
        if disposal == 2:
            seen[...] = 0
        elif before is not None:
            canvas = before
        delay, disposal, transparent = 0, 0, -1


def write_gif(frames: list[tuple[np.ndarray, int]], palette: np.ndarray = PALETTE, compress: bool = True) -> bytes:
    """A GIF of frames of colour indices (rows by columns, with a delay in ms), drawn at the top left, kept when done."""
    width, height = max(f.shape[1] for f, _ in frames), max(f.shape[0] for f, _ in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    for grid, delay in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay // 10, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, grid.shape[1], grid.shape[0], 0) + b"\x08")
        stream = lzw_encode(grid.tobytes(), compress=compress)
        out += [bytes((len(p),)) + p for p in (stream[i : i + 255] for i in range(0, len(stream), 255))]
        out.append(b"\0")
    return b"".join(out) + b"\x3b"


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Opaque pixels by colour, in 64 bins: two bits each of red, green and blue."""
    c = canvas[canvas[..., 3] > 0].astype(np.int64)
    return np.bincount((c[:, 0] >> 6) << 4 | (c[:, 1] >> 6) << 2 | c[:, 2] >> 6, minlength=BINS)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 and its length without, and with, spaces up to a positive multiple of 192 bytes."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    return len(data), data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\x20")


def encode_payload(payload: bytes, compress: bool = True) -> bytes:
    """The payload as an image of 192 columns, in frames of up to 512 rows, a tenth of a second each."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return write_gif([(grid[i : i + FRAME_ROWS], 100) for i in range(0, len(grid), FRAME_ROWS)], compress=compress)


def store_texts(docs: DataFrame, text_col: str = "text", media_col: str = "media", compress: bool = True) -> DataFrame:
    """``docs`` with the whole text of each row as a GIF in ``media_col``, and ``n_bytes``, the text's UTF-8 length.

    A null text is stored as an empty one, which is one row of spaces.  Equal texts
    give equal bytes.  Columns of the new names are replaced.  Without ``compress``
    the codes are left uncompressed, which is faster and takes more room.  Rows that repeat
    are stored one by one, an empty table gives none; other columns stay as they are.
    """

    @F.pandas_udf("n_bytes long, media binary")
    def store(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out, size = [], 0
            for text in texts:
                n, payload = payload_of(text)
                out.append((n, encode_payload(payload, compress)))
                size += len(out[-1][1])
                if size > HELD:
                    yield pd.DataFrame(out, columns=["n_bytes", "media"])
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=["n_bytes", "media"])

    return docs.withColumn("__stored", store(F.col(text_col).cast("string"))).withColumns({"n_bytes": F.col("__stored.n_bytes"), media_col: F.col("__stored.media")}).drop("__stored")


def read_media(rows: DataFrame, media_col: str = "media", with_payload: bool = True, max_pixels: int = 1 << 28) -> DataFrame:
    """``rows`` with ``frames`` (timed, with colour histograms), ``payload`` and ``error`` read from the stored bytes.

    ``histogram`` is of the canvas as shown, ``own_histogram`` of the frame's own pixels.
    ``payload`` is the colour indices of all frames, one after the other.  Bytes that
    are no GIF, or a damaged one, give the frames before the damage, a null payload and
    the reason in ``error``; null media give null frames and no error.  Screens and frames
    of more than ``max_pixels`` are an error.  Columns of the three names are replaced.
    What is read leaves the worker in parts of bounded size.  Rows that repeat are read one
    by one, an empty table gives none.
    """
    fields = [f.split(" ")[0] for f in FRAME.split(", ")]
    frame_type = ", ".join(f"{n}: {t}" for n, t in (f.split(" ", 1) for f in FRAME.split(", ")))

    @F.pandas_udf(f"frames array<struct<{frame_type}>>, payload binary, error string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for media in batches:
            out, size = [], 0
            for data in media:
                out.append(_read_one(data, fields, with_payload, max_pixels))
                size += len(data or b"") + len(out[-1][1] or b"")
                if size > HELD:
                    yield pd.DataFrame(out, columns=["frames", "payload", "error"])
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=["frames", "payload", "error"])

    return rows.withColumn("__read", read(F.col(media_col))).withColumns({n: F.col(f"__read.{n}") for n in ("frames", "payload", "error")}).drop("__read")


def _read_one(data: bytes | None, fields: list[str], with_payload: bool, max_pixels: int) -> tuple:
    if data is None:
        return None, None, None
    frames, parts, error = [], [], None
    try:
        for i, f in enumerate(read_gif(bytes(data), max_pixels)):
            values = (i, f.at_ms, f.delay_ms, f.left, f.top, f.width, f.height, f.disposal, f.transparent, histogram(f.canvas).tolist(), histogram(f.own).tolist())
            frames.append(dict(zip(fields, values, strict=True)))
            if with_payload:
                parts.append(f.indices)
    except GifError as e:
        error = str(e)
    return frames, b"".join(parts) if with_payload and error is None else None, error


def frame_rows(media: DataFrame) -> DataFrame:
    """One row a frame of ``read_media``'s rows: their other columns and the frame's fields.

    Null media, and those damaged before their first frame, have no row; rows that repeat
    have theirs each; an empty table gives none.
    """
    keep = [c for c in media.columns if c not in ("frames", "payload", "error")]
    return media.select(*keep, F.explode("frames").alias("f")).select(*keep, "f.*")

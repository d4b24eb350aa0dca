"""TIFF media columns: write text payloads as TIFF files and read TIFF files page by page.

The reader walks the chain of image directories, decodes strips or tiles that are
stored plain, as PackBits, LZW or deflate, undoes the horizontal predictor, and gives
one row per page. Both byte orders and 8-bit samples (one or more per pixel, chunky)
are supported. The writer makes 8-bit grey pages of one directory each.

Work is per row inside Arrow batches; Spark deals the rows.

Defined cases
* null text counts as empty; the payload is then 64 zero bytes.
* a file that is not a readable TIFF, or a null one, gives one row with page -1 and ``error``.
* strips and tiles are decoded up to their size in the directory, whatever more their data hold.
* repeated rows: equal bytes give equal rows. An empty table gives an empty result.
* names of added columns replace input columns of the same name; other columns pass through ``encode_texts``.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 64
EXPANSION = 2800  # no stored byte of any of the schemes becomes more bytes than this
STRIP_ROWS = 128
# fixed values of the format: tags, compression codes, field sizes by type
IMAGE_WIDTH, IMAGE_LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes become repeats, the rest literals."""
    out = bytearray()

    def literal(part: bytes) -> None:
        for at in range(0, len(part), 128):
            piece = part[at : at + 128]
            out.append(len(piece) - 1)
            out.extend(piece)

    done = 0
    for run in re.finditer(rb"(.)\1{2,127}", data, re.DOTALL):
        literal(data[done : run.start()])
        out.append(257 - (run.end() - run.start()))
        out.append(data[run.start()])
        done = run.end()
    literal(data[done:])
    return bytes(out)


def packbits_decode(data: bytes, limit: int = 1 << 62) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < limit:
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        else:
            if head > 128:
                out += data[at + 1 : at + 2] * (257 - head)
            at += 2 if head > 128 else 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Variable-width codes, most significant bit first, widths growing one code early."""
    table = {bytes((k,)): k for k in range(256)}
    acc, width, following, kept = 256, 9, 258, 9
    out, word = bytearray(), b""
    get = table.get
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        acc = (acc << width) | get(word)
        kept += width
        table[longer] = following
        following += 1
        word = data[k : k + 1]
        if following == 512 or following == 1024 or following == 2048:
            width += 1
        elif following == 4095:
            acc = (acc << width) | 256
            kept += width
            table = {bytes((k,)): k for k in range(256)}
            get = table.get
            width, following = 9, 258
        if kept >= 4096:
            keep = kept & 7
            out += (acc >> keep).to_bytes((kept - keep) >> 3, "big")
            acc, kept = acc & ((1 << keep) - 1), keep
    if word:
        acc = (acc << width) | table[word]
        kept += width
        following += 1
        if following in (512, 1024, 2048):
            width += 1
    acc = (acc << width) | 257
    kept += width
    pad = -kept % 8
    return bytes(out) + (acc << pad).to_bytes((kept + pad) >> 3, "big")


def lzw_decode(data: bytes, limit: int = 1 << 62) -> bytes:
    base = [bytes((k,)) for k in range(256)] + [b"", b""]
    table, width, previous = list(base), 9, None
    out, acc, bits, at, made = [], 0, 0, 0, 0
    while made < limit:
        while bits < width:
            if at >= len(data):
                return b"".join(out)
            piece = data[at : at + 16]
            acc = ((acc & ((1 << bits) - 1)) << (8 * len(piece))) | int.from_bytes(piece, "big")
            bits += 8 * len(piece)
            at += 16
        bits -= width
        code = (acc >> bits) & ((1 << width) - 1)
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, previous = list(base), 9, None
            continue
        if previous is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else previous + previous[:1]
            table.append(previous + entry[:1])
            if len(table) == 511 or len(table) == 1023 or len(table) == 2047:
                width += 1
        out.append(entry)
        made += len(entry)
        previous = entry
    return b"".join(out)


def inflate(data: bytes, limit: int) -> bytes:
    """At most ``limit`` bytes of a deflate stream; what a longer one holds beyond is never made."""
    stream = zlib.decompressobj()
    out = stream.decompress(data, limit)
    if not stream.eof and not stream.decompress(stream.unconsumed_tail, 1) and not stream.eof:  # the last step reads the checksum
        raise ValueError("deflate data end early")
    return out


_ENCODE = {PLAIN: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 6)}
_DECODE = {PLAIN: lambda x, limit: x[:limit], PACKBITS: packbits_decode, LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate}


def _differences(rows: np.ndarray, step: int) -> np.ndarray:
    out = rows.copy()
    out[:, step:] -= rows[:, :-step]
    return out


def _undo_differences(rows: np.ndarray, step: int) -> np.ndarray:
    parts = rows.reshape(len(rows), -1, step)
    return np.add.accumulate(parts, axis=1, dtype=np.uint8).reshape(len(rows), -1)


def write_page(payload: bytes, width: int = WIDTH, compression: int = DEFLATE, predictor: int = 1, tile: int = 0, strip_rows: int = STRIP_ROWS) -> bytes:
    """A TIFF of one grey page; ``payload`` fills whole rows. ``tile`` > 0 stores square tiles of that size instead of strips."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    height = len(image)
    if tile:
        padded = np.pad(image, ((0, -height % tile), (0, -width % tile)))
        parts = [padded[y : y + tile, x : x + tile] for y in range(0, len(padded), tile) for x in range(0, padded.shape[1], tile)]
    else:
        parts = [image[y : y + strip_rows] for y in range(0, height, strip_rows)]
    blobs = [_ENCODE[compression]((_differences(p, 1) if predictor == 2 else p).tobytes()) for p in parts]
    body = b"".join(blobs)
    body += b"\0" * (len(body) % 2)
    counts = np.array([len(b) for b in blobs], "<u4")
    offsets = (8 + np.concatenate(([0], np.cumsum(counts)[:-1]))).astype("<u4")
    tables = 8 + len(body)
    listed = (TILE_OFFSETS, TILE_COUNTS) if tile else (STRIP_OFFSETS, STRIP_COUNTS)
    inline = len(blobs) == 1
    fields = [(IMAGE_WIDTH, 4, 1, width), (IMAGE_LENGTH, 4, 1, height), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor)]
    fields += [(TILE_WIDTH, 4, 1, tile), (TILE_LENGTH, 4, 1, tile)] if tile else [(ROWS_PER_STRIP, 4, 1, strip_rows)]
    fields += [(listed[0], 4, len(blobs), int(offsets[0]) if inline else tables), (listed[1], 4, len(blobs), int(counts[0]) if inline else tables + 4 * len(blobs))]
    extra = b"" if inline else offsets.tobytes() + counts.tobytes()
    directory = struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in sorted(fields)) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", tables + len(extra)) + body + extra + directory


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    """Fields of one directory as lists of integers, and the next directory's offset."""
    (count,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for k in range(count):
        place = at + 2 + 12 * k
        tag, kind, n = struct.unpack_from(order + "HHI", data, place)
        if kind not in (1, 3, 4):
            continue
        size = FIELD_SIZE[kind] * n
        start = place + 8 if size <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
        fields[tag] = list(struct.unpack_from(f"{order}{n}{'BHI'[(1, 3, 4).index(kind)]}", data, start))
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(width, height, samples, pixels) of each page."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise ValueError("not a TIFF")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        f, at = _directory(data, at, order)
        width, height, samples = f[IMAGE_WIDTH][0], f[IMAGE_LENGTH][0], f.get(SAMPLES, [1])[0]
        if any(b != 8 for b in f.get(BITS, [8])):
            raise ValueError("samples are not 8 bits")
        decode, predictor = _DECODE[f.get(COMPRESSION, [1])[0]], f.get(PREDICTOR, [1])[0]
        tiled = TILE_OFFSETS in f
        across, down = (f[TILE_WIDTH][0], f[TILE_LENGTH][0]) if tiled else (width, min(f.get(ROWS_PER_STRIP, [height])[0], height))
        stored = min(len(data), sum(f[TILE_COUNTS if tiled else STRIP_COUNTS]))
        if across < 1 or down < 1 or samples < 1:
            raise ValueError("empty tiles or strips")
        shape = (-(-height // down) * down, -(-width // across) * across * samples)
        if shape[0] * shape[1] > 2 * EXPANSION * stored:
            raise ValueError("more pixels than the file can hold")
        image = np.zeros(shape, np.uint8)
        columns = -(-width // across)
        for k, (offset, count) in enumerate(zip(f[TILE_OFFSETS if tiled else STRIP_OFFSETS], f[TILE_COUNTS if tiled else STRIP_COUNTS])):
            part = np.frombuffer(decode(data[offset : offset + count], across * samples * down), np.uint8)
            part = part[: len(part) // (across * samples) * across * samples].reshape(-1, across * samples)
            part = _undo_differences(part, samples) if predictor == 2 else part
            y, x = k // columns * down, k % columns * across * samples
            image[y : y + len(part[:down]), x : x + across * samples] = part[:down]
        yield width, height, samples, image[:height, : width * samples].tobytes()


def payload_of(text: bytes) -> bytes:
    """Text bytes with zeros up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % WIDTH or (0 if text else WIDTH))


def layout_of(payload: bytes) -> tuple[int, int, int]:
    """(compression, predictor, tile) of a payload: the checksum picks one of six, so equal payloads look alike."""
    choices = ((DEFLATE, 1, 0), (DEFLATE, 2, 0), (PACKBITS, 1, 0), (DEFLATE, 1, 64), (LZW, 1, 0), (PACKBITS, 2, 32))
    return choices[zlib.crc32(payload) % len(choices)]


def encode_texts(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """``docs`` with n_bytes and a TIFF of each text in place of the text."""
    kept = [f for f in docs.schema.fields if f.name not in (text_col, media_col, "n_bytes")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x.as_py() or "").encode() for x in batch.column(text_col)]
            files = []
            for text in texts:
                payload = payload_of(text)
                compression, predictor, tile = layout_of(payload)
                files.append(write_page(payload, WIDTH, compression, predictor, tile))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], names=[*(f.name for f in kept), "n_bytes", media_col])

    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField(media_col, T.BinaryType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept], text_col).mapInArrow(work, schema)


PAGE_FIELDS = [T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("samples", T.IntegerType()), T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType())]


def decode_pages(files: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page of each file: page (from 0), width, height, samples, pixels, error; other columns, the file among them, repeat."""
    added = {f.name for f in PAGE_FIELDS}
    kept = [f for f in files.schema.fields if f.name not in added]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pages = [], []
            for k, x in enumerate(batch.column(media_col)):
                try:
                    found = [(n, *page, None) for n, page in enumerate(read_pages(x.as_py() or b""))]
                except (ValueError, KeyError, IndexError, struct.error, zlib.error, MemoryError) as problem:
                    found = [(-1, None, None, None, None, f"{type(problem).__name__}: {problem}"[:200])]
                rows += [k] * len(found)
                pages += found
            columns = list(zip(*pages)) if pages else [[]] * 6
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            index = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(index) for f in kept), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=[*(f.name for f in kept), *(f.name for f in PAGE_FIELDS)])

    return files.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(work, T.StructType([*kept, *PAGE_FIELDS]))


def page_features(pages: DataFrame) -> DataFrame:
    """``pages`` with feature: mean, deviation and entropy of the samples and their shares in eight equal ranges."""
    kept = [f for f in pages.schema.fields if f.name != "feature"]

    def feature(pixels: bytes | None) -> str | None:
        if pixels is None:
            return None
        counts = np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
        total = max(int(counts.sum()), 1)
        share = counts / total
        mean = float(share @ np.arange(256))
        spread = float(np.sqrt(max(share @ (np.arange(256) - mean) ** 2, 0.0)))
        some = share[share > 0]
        bands = ",".join(f"{x:.4f}" for x in share.reshape(8, 32).sum(axis=1))
        return f"mean={mean:.4f};std={spread:.4f};entropy={float(-(some * np.log2(some)).sum()) + 0.0:.4f};bands={bands}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array([feature(x.as_py()) for x in batch.column("pixels")], pa.string())], names=[*(f.name for f in kept), "feature"])

    return pages.mapInArrow(work, T.StructType([*kept, T.StructField("feature", T.StringType())]))


def media_digest(pages: DataFrame, media_col: str = "media") -> DataFrame:
    """Digest columns of one-page files: payload and file sizes and hashes, and the tail's checksum."""
    size = F.length("pixels")
    return pages.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("pixels"), -64, 64)).alias("tail_crc32"),
        F.length(media_col).cast("long").alias("media_bytes"),
        F.sha2(media_col, 256).alias("media_sha256"),
        "feature",
    )

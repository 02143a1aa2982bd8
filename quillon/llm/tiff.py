"""TIFF media columns: a writer for baseline grey images, and a reader that gives one row for each page.

``read_pages`` walks the chain of image directories of classic little- or big-endian TIFF, decodes strips or
tiles (none, PackBits, LZW, deflate), undoes the horizontal predictor and returns each page's samples.
``write_page`` stores 8-bit samples as one grey page, losslessly, in strips or tiles.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.runtime import ship_package, table

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_KINDS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
WIDTH, MAGIC = 192, b"II*\x00"
#: A page of more samples is not read.
MOST_SAMPLES = 1 << 28
PAGE_TYPE = "page int, width int, height int, samples_per_pixel int, bits int, compression int, predictor int, pixels binary, palette binary, error string"


@dataclass
class Page:
    page: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: bytes
    palette: bytes | None = None


def packbits_decode(data: bytes, most: int | None = None) -> bytes:
    """At most ``most`` bytes and the rest of a run."""
    out, i = bytearray(), 0
    while i < len(data) and (most is None or len(out) < most):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def packbits_encode(row: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(row)
    while i < n:
        j = i + 1
        while j < n and row[j] == row[i] and j - i < 128:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), row[i]))
        else:
            while j < n and j - i < 128 and not (j + 1 < n and row[j] == row[j + 1]):
                j += 1
            out += bytes((j - i - 1,)) + row[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table and 257 ends, as do ``most`` bytes."""
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    names, width, held, bits, last = list(first), 9, 0, 0, None
    out, size = [], 0
    for byte in data:
        if most is not None and size >= most:
            break
        held = (held << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            names, width, last = list(first), 9, None
            continue
        if last is None:
            word = names[code]
        else:
            word = names[code] if code < len(names) else last + last[:1]
            names.append(last + word[:1])
            # the width grows one code early
            if len(names) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(word)
        size += len(word)
        last = word
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    table, width, held, bits, out = {bytes((i,)): i for i in range(256)}, 9, 0, 0, bytearray()
    size, word = 258, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held = (held << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    put(256)
    for i in range(len(data)):
        more = word + data[i : i + 1]
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = size
        size += 1
        if size >= 4094:
            put(256)
            table, width, size = {bytes((i,)): i for i in range(256)}, 9, 258
        elif size >= (1 << width):
            width += 1
        word = data[i : i + 1]
    if word:
        put(table[word])
        size += 1
        if size >= (1 << width) and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def _decode(data: bytes, how: int, most: int) -> bytes:
    """The decoded bytes, of which at most ``most`` and one more are made."""
    if how == NONE:
        return data[:most]
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    if how == PACKBITS:
        return packbits_decode(data, most)
    if how == LZW:
        return lzw_decode(data, most)
    raise ValueError(f"compression {how} is not supported")


def _encode(data: bytes, how: int, row: int) -> bytes:
    if how == NONE:
        return data
    if how == DEFLATE:
        return zlib.compress(data, 1)
    if how == PACKBITS:
        return b"".join(packbits_encode(data[i : i + row]) for i in range(0, len(data), row))
    if how == LZW:
        return lzw_encode(data)
    raise ValueError(f"compression {how} is not supported")


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size = _SIZES.get(kind, 1) * count
        where = at + 10 + 12 * i
        if size > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        if kind in _KINDS:
            tags[tag] = struct.unpack_from(f"{order}{count}{_KINDS[kind]}", data, where)
        elif kind == 2:
            tags[tag] = (data[where : where + count].rstrip(b"\x00").decode("ascii", "replace"),)
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, following


def _each_page(data: bytes) -> Iterator[Page | ValueError]:
    """The pages in order, for one that can't be read its error. The end is where the chain of directories is lost."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        yield ValueError("not a TIFF file")
        return
    (at,) = struct.unpack_from(order + "I", data, 4)
    number, seen = 0, set()
    while at:
        if at in seen:
            yield ValueError("the chain of directories has a loop")
            return
        seen.add(at)
        following = 0
        try:
            tags, following = _directory(data, at, order)
            yield _page(data, tags, number, order)
        except ValueError as e:
            yield e
        except (struct.error, KeyError, IndexError, zlib.error, ArithmeticError, MemoryError, TypeError) as e:
            error = ValueError(f"page {number} is broken: {type(e).__name__} {e}")
            error.__cause__ = e
            yield error
        number, at = number + 1, following


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages in order. A file that breaks the format raises ValueError at the page where it does."""
    for page in _each_page(data):
        if isinstance(page, ValueError):
            raise page
        yield page


def _page(data: bytes, tags: dict[int, tuple], number: int, order: str) -> Page:
    width, height = tags[256][0], tags[257][0]
    bits, samples = tags.get(258, (1,))[0], tags.get(277, (1,))[0]
    if min(width, height, samples) < 1 or width * height * samples > MOST_SAMPLES:
        raise ValueError(f"{width} x {height} samples of {samples} are none or over {MOST_SAMPLES}")
    how, predictor = tags.get(259, (NONE,))[0], tags.get(317, (1,))[0]
    if bits not in (1, 2, 4, 8, 16) or bits < 8 and (predictor != 1 or tags.get(266, (1,))[0] != 1) or tags.get(284, (1,))[0] != 1 or predictor not in (1, 2):
        raise ValueError(f"{bits} bits, predictor {predictor} or separate planes are not supported")
    # samples of less than a byte get one each; palette pages give their indices, and the palette beside them
    kind = np.dtype(f"{order}u{max(1, bits // 8)}")
    out = np.zeros((height, width, samples), dtype=kind)
    if 322 in tags:
        wide, tall, starts, counts = tags[322][0], tags[323][0], tags[324], tags[325]
    else:
        wide, tall, starts, counts = width, min(tags.get(278, (height,))[0], height), tags[273], tags[279]
    if min(wide, tall) < 1:
        raise ValueError(f"page {number} has strips or tiles without a size")
    across = -(-width // wide)
    for i, (a, n) in enumerate(zip(starts, counts, strict=True)):
        if a + n > len(data):
            raise ValueError(f"page {number} is cut short")
        y, x = i // across * tall, i % across * wide
        rows = tall if 322 in tags else min(tall, height - y)
        if y >= height or rows < 1 or rows * wide * samples > MOST_SAMPLES:
            raise ValueError(f"page {number} has strips or tiles beyond its size")
        line = -(-wide * samples * bits // 8)
        raw = _decode(data[a : a + n], how, rows * line)
        if bits < 8:
            packed = np.frombuffer(raw, dtype=kind, count=rows * line).reshape(rows, line)
            each = np.unpackbits(packed, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits)[::-1]).astype(np.uint8)
            part = each[:, : wide * samples].reshape(rows, wide, samples)
        else:
            part = np.frombuffer(raw, dtype=kind, count=rows * wide * samples).reshape(rows, wide, samples)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        out[y : y + rows, x : x + wide] = part[: height - y, : width - x]
    palette = np.asarray(tags[320], dtype="<u2").tobytes() if tags.get(262, (1,))[0] == 3 and 320 in tags else None
    return Page(number, width, height, samples, bits, how, predictor, out.tobytes(), palette)


def write_page(pixels: bytes, width: int = WIDTH, compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 64, tile: int | None = None) -> bytes:
    """One grey page of 8-bit samples; ``tile``: square tiles of that side (a multiple of 16) in place of strips."""
    height = len(pixels) // width
    if height * width != len(pixels) or not pixels:
        raise ValueError("the samples do not fill whole rows")
    img = np.frombuffer(pixels, dtype=np.uint8).reshape(height, width)
    if tile:
        img = np.pad(img, ((0, -height % tile), (0, -width % tile)))
        parts = [img[y : y + tile, x : x + tile] for y in range(0, img.shape[0], tile) for x in range(0, img.shape[1], tile)]
    else:
        parts = [img[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
    stored = []
    for p in parts:
        if predictor == 2:
            p = np.diff(p, axis=1, prepend=np.uint8(0))
        stored.append(_encode(p.tobytes(), compression, p.shape[1]))
    n, body = len(stored), b"".join(stored)
    starts = np.cumsum([8, *(len(s) for s in stored[:-1])])
    tags = [(256, 4, (width,)), (257, 4, (height,)), (258, 3, (8,)), (259, 3, (compression,)), (262, 3, (1,)), (277, 3, (1,)), (317, 3, (predictor,))]
    places, lengths = tuple(map(int, starts)), tuple(map(len, stored))
    tags += [(322, 4, (tile,)), (323, 4, (tile,)), (324, 4, places), (325, 4, lengths)] if tile else [(273, 4, places), (278, 4, (rows_per_strip,)), (279, 4, lengths)]
    body += b"\x00" * (len(body) % 2)
    at = 8 + len(body)
    beyond, entries = at + 2 + 12 * len(tags) + 4, []
    extra = b""
    for tag, kind, values in sorted(tags):
        raw = struct.pack(f"<{len(values)}{_KINDS[kind]}", *values)
        if len(raw) > 4:
            entries.append(struct.pack("<HHII", tag, kind, len(values), beyond + len(extra)))
            extra += raw
        else:
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\x00"))
    return MAGIC + struct.pack("<I", at) + body + struct.pack("<H", len(tags)) + b"".join(entries) + b"\x00\x00\x00\x00" + extra


def explode_pages(df: DataFrame, media: str) -> DataFrame:
    """One row for each page of the TIFF files in column ``media``, other columns repeated.

    Null files, and each page that can't be read, give one row with a null page and what is wrong in ``error`` (null
    for null); pages before and after it are read. A name of ``PAGE_TYPE`` that ``df`` has already is replaced.
    """
    ship_package(df.sparkSession)
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(PAGE_TYPE)
    keep = [c for c in df.columns if c not in new.names]
    kept = df.select(*(F.col(f"`{c}`") for c in keep))

    def rows(files: pd.Series) -> pd.Series:
        out = []
        for f in files:
            got = []
            if f is not None:
                for p in _each_page(bytes(f)):
                    if isinstance(p, ValueError):
                        got.append((None,) * 9 + (str(p),))
                    else:
                        got.append((p.page, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.pixels, p.palette, None))
            out.append([dict(zip(new.names, g, strict=True)) for g in got or [(None,) * 10]])
        return pd.Series(out)

    decode = F.pandas_udf(rows, f"array<struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in new.fields)}>>")
    return kept.withColumn("_pages", F.explode(decode(F.col(media)))).select(*(F.col(f"`{c}`") for c in keep), "_pages.*")


def payload_of(text: str | None) -> bytes:
    """UTF-8, filled up with spaces to a positive multiple of the row width."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return raw + b" " * (WIDTH - len(raw) if len(raw) < WIDTH else -len(raw) % WIDTH)


def _features(page: Page) -> str:
    a = np.frombuffer(page.pixels, dtype=np.uint8)
    count = np.bincount(a, minlength=256)
    share = count[count > 0] / len(a)
    return f"{page.width}x{page.height};c{page.compression};p{page.predictor};mean={a.mean():.4f};sd={a.std():.4f};entropy={-(share * np.log2(share)).sum():.4f};distinct={len(share)}"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text in b.column("text").to_pylist():
            media = write_page(payload_of(text))
            (page,) = read_pages(media)
            back = page.pixels
            size = len(text.encode("utf-8", "surrogatepass")) if text else 0
            out.append((size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), _features(page)))
        names = [c.split()[0] for c in _DIGEST.split(", ")]
        columns = [pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*out, strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names)


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def op10_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's bytes stored as a grey TIFF page, read back with the directory walker and measured.

    Null and empty texts are one row of spaces. Rows are taken one by one, so repeated rows, equal texts and null ids give rows of
    equal values, and an empty table none.
    """
    ship_package(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(_digest, _DIGEST)

"""Media columns: signature sniffing, and a lossless 8-bit sample form for bytes.

An Aho-Corasick automaton finds all magic bytes in one pass; a validator of the format then confirms structure and
length, so a chance magic is no medium. What begins at 0 corrects the declared type; what begins later is embedded.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The magic bytes of the formats.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png", b"GIF87a": "image/gif", b"GIF89a": "image/gif", b"\xff\xd8\xff": "image/jpeg", b"BM": "image/bmp", b"RIFF": "riff", b"\x1f\x8b\x08": "application/gzip",
    b"%PDF-": "application/pdf", b"PK\x03\x04": "application/zip", b"OggS": "audio/ogg", b"fLaC": "audio/flac", b"ftyp": "video/mp4",
}
#: Bytes before the magic that belong to the medium.
LEAD = {"video/mp4": 4}
RIFF_KINDS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}
RIFF_FIRST = {b"WAVE": (b"fmt ",), b"WEBP": (b"VP8 ", b"VP8L", b"VP8X"), b"AVI ": (b"LIST",)}
ZIP_ENTRY = re.compile(rb"PK(?:\x03\x04|\x01\x02)")
BLOCK = 192


class Seen(set):
    """Places that a validator has passed without success: another start that gets there fails too, so each place is passed once."""

    def fails(self, place: int) -> bool:
        if place in self:
            return True
        self.add(place)
        return False


def png_length(b: bytes, at: int, seen: Seen) -> int:
    place = at + 8
    while place + 12 <= len(b) and not seen.fails(place):
        n, kind = struct.unpack_from(">I4s", b, place)
        if place == at + 8 and (n, kind) != (13, b"IHDR"):
            return 0
        if place + 12 + n > len(b) or zlib.crc32(b[place + 4 : place + 8 + n]) != struct.unpack_from(">I", b, place + 8 + n)[0]:
            return 0
        place += 12 + n
        if kind == b"IEND":
            return place - at
    return 0


def gif_length(b: bytes, at: int, seen: Seen) -> int:
    def blocks(place):
        while place < len(b) and b[place]:
            if seen.fails(~place):
                return len(b)
            place += 1 + b[place]
        return place + 1

    if at + 13 > len(b):
        return 0
    place = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    while place < len(b) and not seen.fails(place):
        if b[place] == 0x3B:
            return place + 1 - at
        if b[place] == 0x21:
            place = blocks(place + 2)
        elif b[place] == 0x2C and place + 10 <= len(b):
            place = blocks(place + 11 + (3 << (b[place + 9] & 7) + 1 if b[place + 9] & 128 else 0))
        else:
            return 0
    return 0


def jpeg_length(b: bytes, at: int, seen: Seen) -> int:
    place = at + 2
    while place + 4 <= len(b) and b[place] == 0xFF and not seen.fails(place):
        kind, n = b[place + 1], struct.unpack_from(">H", b, place + 2)[0]
        if n < 2:
            return 0
        place += 2 + n
        if kind == 0xDA:  # entropy-coded data up to the next marker
            if seen.fails(~place):
                return 0
            while (place := b.find(b"\xff", place)) >= 0 and place + 1 < len(b) and (b[place + 1] == 0 or 0xD0 <= b[place + 1] <= 0xD7):
                if seen.fails(~place):
                    return 0
                place += 2
            if place < 0 or place + 1 >= len(b):
                return 0
        if b[place : place + 2] == b"\xff\xd9":
            return place + 2 - at
    return 0


def bmp_length(b: bytes, at: int, seen: Seen) -> int:
    if at + 54 > len(b):
        return 0
    n, reserved, offset, header = struct.unpack_from("<IIII", b, at + 2)
    return n if not reserved and header in (40, 108, 124) and 14 + header <= offset <= n <= len(b) - at else 0


def riff_length(b: bytes, at: int, seen: Seen) -> int:
    """Its stated length must be there, and its first chunk be one that its kind begins with and fit in."""
    if at + 20 > len(b) or b[at + 8 : at + 12] not in RIFF_FIRST:
        return 0
    whole, (kind, first) = struct.unpack_from("<I", b, at + 4)[0] + 8, struct.unpack_from("<4sI", b, at + 12)
    return whole if kind in RIFF_FIRST[b[at + 8 : at + 12]] and at + whole <= len(b) and 20 + first <= whole else 0


def gzip_length(b: bytes, at: int, seen: Seen) -> int:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return 0
    unpacker, place = zlib.decompressobj(31), at
    try:
        while place < len(b) and not unpacker.eof:
            held = unpacker.decompress(b[place : place + 65536], 1 << 20)
            while unpacker.unconsumed_tail and held:
                held = unpacker.decompress(unpacker.unconsumed_tail, 1 << 20)
            place += 65536
    except zlib.error:
        return 0
    return min(place, len(b)) - len(unpacker.unused_data) - at if unpacker.eof else 0


def pdf_length(b: bytes, at: int, seen: Seen) -> int:
    """Up to the last end mark before the next PDF; the place of the cross references must be stated before it."""
    if at + 8 > len(b) or not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b".":
        return 0
    following = b.find(b"%PDF-", at + 5)
    mark = b.rfind(b"%%EOF", at, following if following >= 0 else len(b))
    if mark < 0 or b.rfind(b"startxref", max(at, mark - 64), mark) < 0:
        return 0
    end = mark + 5
    return end - at + (2 if b[end : end + 2] == b"\r\n" else b[end : end + 1] in (b"\n", b"\r"))


def zip_length(b: bytes, at: int, seen: Seen) -> int:
    """Local entries one after the other, then the directory, then its end record, which states how many there are."""
    place = at
    while b[place : place + 4] == b"PK\x03\x04" and place + 30 <= len(b) and not seen.fails(place):
        flags, _, _, _, _, packed, _, name, extra = struct.unpack_from("<HHHHIIIHH", b, place + 6)
        if flags & 8:  # sizes follow the data: the next entry's mark ends it
            following = ZIP_ENTRY.search(b, place + 4)
            if following is None:
                return 0
            place = following.start()
        else:
            place += 30 + name + extra + packed
    listed = 0
    while b[place : place + 4] == b"PK\x01\x02" and place + 46 <= len(b) and not seen.fails(place):
        name, extra, comment = struct.unpack_from("<HHH", b, place + 28)
        place += 46 + name + extra + comment
        listed += 1
    if b[place : place + 4] != b"PK\x05\x06" or place + 22 > len(b) or not listed or struct.unpack_from("<H", b, place + 10)[0] != listed:
        return 0
    end = place + 22 + struct.unpack_from("<H", b, place + 20)[0]
    return end - at if end <= len(b) else 0


def ogg_length(b: bytes, at: int, seen: Seen) -> int:
    """Pages from the first to the last of a stream."""
    place = at
    while b[place : place + 5] == b"OggS\0" and place + 27 <= len(b) and not seen.fails(place):
        kind, segments = b[place + 5], b[place + 26]
        if place == at and not kind & 2:
            return 0
        place += 27 + segments + sum(b[place + 27 : place + 27 + segments])
        if place > len(b):
            return 0
        if kind & 4:
            return place - at
    return 0


def flac_length(b: bytes, at: int, seen: Seen) -> int:
    """The metadata blocks of a stream; its frames, of unstated length, reach to the end of the bytes."""
    place, first = at + 4, True
    while place + 4 <= len(b) and not seen.fails(place):
        kind, n = b[place], int.from_bytes(b[place + 1 : place + 4], "big")
        if first and (kind & 127 or n != 34):
            return 0
        place, first = place + 4 + n, False
        if kind & 128:
            return len(b) - at if b[place : place + 1] == b"\xff" and place + 1 < len(b) and b[place + 1] & 0xFE == 0xF8 else 0
    return 0


def mp4_length(b: bytes, at: int, seen: Seen) -> int:
    """Boxes one after the other, of names in printable letters, with a movie or media data among them."""
    place, kinds = at, set()
    while place + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, place)
        if not all(32 <= c < 127 for c in kind):
            break
        n = struct.unpack_from(">Q", b, place + 8)[0] if n == 1 and place + 16 <= len(b) else n
        if n < 8 or place + n > len(b) or place > at and kind == b"ftyp" or seen.fails(place):
            break
        kinds.add(kind)
        place += n
    return place - at if b"ftyp" in kinds and kinds & {b"moov", b"mdat", b"moof"} else 0


LENGTH = {
    "image/png": png_length, "image/gif": gif_length, "image/jpeg": jpeg_length, "image/bmp": bmp_length, "riff": riff_length, "application/gzip": gzip_length,
    "application/pdf": pdf_length, "application/zip": zip_length, "audio/ogg": ogg_length, "audio/flac": flac_length, "video/mp4": mp4_length,
}


@functools.cache
def automaton():
    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic) + LEAD.get(kind, 0), kind))
    found.make_automaton()
    return found


def sniff(b: bytes | None) -> list[tuple[str, int, int]]:
    """(type, start, length) of the outermost confirmed media, in order."""
    out, free, seen = [], 0, {}
    for end, (n, kind) in automaton().iter((b or b"").decode("latin-1")):
        start = end + 1 - n
        if start >= free and (length := LENGTH[kind](b, start, seen.setdefault(kind, Seen()))):
            out.append((RIFF_KINDS[b[start + 8 : start + 12]] if kind == "riff" else kind, start, length))
            free = start + length if start else 1  # what a medium that fills the column holds is looked into
            seen.clear()
    return out


def sniff_media(df: DataFrame, media="media", declared="declared", into="sniffed") -> DataFrame:
    """Adds `into`: type (found at 0, else the declared one), corrected (they differ), length (0 if nothing is confirmed), embedded (type, start, length, bytes).

    A null declared type is corrected by any that is found. Null and empty media: the declared type, no length. No
    magic begins another, so there are no ties. Long media are read whole, each place about once, but for media crafted
    to begin a long PNG chunk or gzip stream at many places. Rows, repeated ones too, and all other columns stay; a column named `into` is replaced; an empty table gives an empty result.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for data, said in batches:
            rows = []
            for b, s in zip(data, said):
                found = sniff(b)
                whole = found[0] if found and found[0][1] == 0 else None
                rows.append((whole[0] if whole else s, bool(whole) and whole[0] != s, whole[2] if whole else 0, [{"type": k, "start": at, "length": n, "bytes": b[at : at + n]} for k, at, n in found if at]))
            yield pd.DataFrame(rows, columns=["type", "corrected", "length", "embedded"])

    kind = "struct<type string, corrected boolean, length long, embedded array<struct<type string, start long, length long, bytes binary>>>"
    return df.withColumn(into, F.pandas_udf(run, kind)(F.col(media), F.col(declared)))


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """One channel of unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def wav_data(b: bytes) -> bytes | None:
    place = 12
    while place + 8 <= len(b):
        kind, n = struct.unpack_from("<4sI", b, place)
        if place + 8 + n > len(b):
            return None
        if kind == b"data":
            return b[place + 8 : place + 8 + n]
        place += 8 + n + n % 2
    return None


def text_media(docs: DataFrame, *, key="doc_id", text="text", declared="image/png") -> DataFrame:
    """Per row of docs: key, n_bytes, media (a wav whose samples are the padded UTF-8 bytes), declared. Null is as empty; long texts are stored whole; repeated rows each give their row; an empty table gives an empty result; other columns are ignored, whatever their names."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: to_wav((b := t.encode("utf-8", "surrogatepass")) + b" " * (max(BLOCK, -(-len(b) // BLOCK) * BLOCK) - len(b))))

    filled = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias(key), F.octet_length(filled).cast("long").alias("n_bytes"), F.pandas_udf(run, "binary")(filled).alias("media"), F.lit(declared).alias("declared"))


def sample_features(media: DataFrame) -> DataFrame:
    """Replaces media and declared by what the stored samples say: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (type, mean, crossings of the mean, embedded media). Media that are no wav: no payload."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for data in batches:
            rows = []
            for b in data:
                x = wav_data(b or b"")
                s = np.frombuffer(x or b"", np.uint8)
                mean = float(s.mean()) if len(s) else 0.0
                rows.append((None if x is None else len(x), None if x is None else hashlib.sha256(x).hexdigest(), None if x is None else zlib.crc32(x[-16:]), len(b or b""), hashlib.sha256(b or b"").hexdigest(), f"{mean:.6f}:{int(np.count_nonzero(np.diff(s > mean)))}"))
            yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "stats"])

    read = F.pandas_udf(run, "struct<payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, stats string>")
    found = sniff_media(media).withColumn("read", read("media"))
    feature = F.concat_ws(":", "sniffed.type", "read.stats", F.size("sniffed.embedded"))
    return found.select(*[c for c in media.columns if c not in ("media", "declared")], *[f"read.{c}" for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")], feature.alias("feature"), "sniffed")

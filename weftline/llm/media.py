"""Media columns: signature sniffing. Aho-Corasick locates magic bytes, validators confirm structure and
length, the declared type is corrected, and media embedded in other bytes are carved out.

`store` keeps a text's bytes as 8-bit PCM samples in a WAVE container; `sniff` reads such a column back.

Every validator reads on from its own place, or looks up the next of some end marks that were located once, so that
bytes full of false starts take linear time. FLAC streams carry no length: one reaches to the end of its bytes.

Defined cases: a null or empty text is stored as one block of fill bytes; very long ones are stored and read whole;
null content sniffs as null type with no spans; truncated or lying headers fail their validator and yield no type;
repeated rows are worked each; an empty table gives an empty table; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table

BLOCK, FILL = 576, b"\xff"
RATE = 8000


class Bytes(bytes):
    """Bytes that remember where marks stand in them."""

    def next_of(self, mark: bytes, at: int) -> int:
        """The next place of the mark from `at` on, or -1."""
        known = self.__dict__.setdefault("places", {})
        if mark not in known:
            known[mark] = [m.start() for m in re.finditer(re.escape(mark), self)]
        k = bisect_left(known[mark], at)
        return known[mark][k] if k < len(known[mark]) else -1


    def walk(self, name: object, at: int, step: Callable[[int], tuple[int, int] | None]) -> list[tuple[int, int]]:
        """Jumps of a chain of parts from `at`: after 1, 2, 4, ... parts the place and the marks of the parts passed. step
        gives the next place and a part's mark, or None at the chain's end. Each place is stepped from once, however
        many chains pass it: chains that start at every mark of a text take n log n steps, not n squared."""
        known = self.__dict__.setdefault("chains", {}).setdefault(name, {})
        way = []
        while at not in known and (found := step(at)) is not None:
            way.append((at, found))
            at = found[0]
        known.setdefault(at, [])
        for place, found in reversed(way):
            jumps = [found]
            while len(further := known[jumps[-1][0]]) >= len(jumps):
                place_after, mark = further[len(jumps) - 1]
                jumps.append((place_after, jumps[-1][1] | mark))
            known[place] = jumps
        return known[way[0][0] if way else at]

    def follow(self, name: object, at: int, limit: int, step: Callable[[int], tuple[int, int] | None]) -> tuple[int, int]:
        """(place, marks) where a chain from `at` first comes over a limit or ends."""
        marks = 0
        self.walk(name, at, step)
        known = self.__dict__["chains"][name]
        while at <= limit and known[at]:
            fits = [k for k, (place, _) in enumerate(known[at]) if place <= limit]
            at, mark = known[at][fits[-1] if fits else 0]
            marks |= mark
        return at, marks


# --- validators: (data, offset) -> length of a sound file that starts there, or None


def riff(data: Bytes, at: int) -> int | None:
    if at + 12 > len(data):
        return None
    size = int.from_bytes(data[at + 4 : at + 8], "little") + 8
    kind = data[at + 8 : at + 12]
    if kind not in (b"WAVE", b"WEBP", b"AVI ") or at + size > len(data) or size < 20:
        return None

    def step(place: int) -> tuple[int, int] | None:
        if place + 8 > len(data):
            return None
        after = place + 8 + int.from_bytes(data[place + 4 : place + 8], "little")
        return after + (after - at & 1), {b"fmt ": 1, b"data": 2}.get(data[place : place + 4], 0)

    place, chunks = data.follow((riff, at & 1), at + 12, at + size - 8, step)
    return size if place >= at + size and place - (at + size) <= 1 and (kind != b"WAVE" or chunks == 3) else None


def png(data: bytes, at: int) -> int | None:
    place = at + 8
    while place + 12 <= len(data):
        n = int.from_bytes(data[place : place + 4], "big")
        kind, end = data[place + 4 : place + 8], place + 12 + n
        if end > len(data) or zlib.crc32(data[place + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return None
        if kind == b"IEND":
            return end - at
        place = end
    return None


def gif(data: bytes, at: int) -> int | None:
    if at + 13 > len(data):
        return None
    flags = data[at + 10]
    place = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)

    def blocks(p):
        while p < len(data) and data[p]:
            p += data[p] + 1
        return p + 1

    while place < len(data):
        mark = data[place]
        if mark == 0x3B:
            return place + 1 - at
        if mark == 0x21:
            place = blocks(place + 2)
        elif mark == 0x2C and place + 10 < len(data):
            local = data[place + 9]
            place = blocks(place + 11 + (3 << ((local & 7) + 1) if local & 128 else 0))
        else:
            return None
    return None


def jpeg(data: Bytes, at: int) -> int | None:
    """Segments by their lengths up to the scan; in it, an end mark cannot occur but as the end."""
    place, frame = at + 2, False
    while place + 4 <= len(data) and data[place] == 0xFF:
        mark = data[place + 1]
        if mark == 0xDA:
            end = data.next_of(b"\xff\xd9", place)
            return end + 2 - at if end > 0 and frame else None
        size = int.from_bytes(data[place + 2 : place + 4], "big")
        if size < 2:
            return None
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        place += 2 + size
    return None


def bmp(data: bytes, at: int) -> int | None:
    if at + 30 > len(data):
        return None
    size, _, start, header = struct.unpack_from("<IIII", data, at + 2)
    return size if header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= start <= size <= len(data) - at else None


def pdf(data: Bytes, at: int) -> int | None:
    end, table = data.next_of(b"%%EOF", at), data.next_of(b"startxref", at)
    return end + 5 - at if 0 < table < end else None


def zipped(data: Bytes, at: int) -> int | None:
    end = data.next_of(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(data):
        return None
    size, start = struct.unpack_from("<II", data, end + 12)
    return end + 22 + int.from_bytes(data[end + 20 : end + 22], "little") - at if at + start + size == end else None


def gzipped(data: Bytes, at: int) -> int | None:
    """The header's fields by their lengths and end marks, the deflated bytes, and their check and size behind them."""
    if at + 18 > len(data) or data[at + 3] & 0xE0:
        return None
    flags, place = data[at + 3], at + 10
    if flags & 4:
        place += 2 + int.from_bytes(data[place : place + 2], "little")
    for flag in (8, 16):  # a name, a comment
        if flags & flag:
            place = data.next_of(b"\0", place) + 1
            if not place:
                return None
    place += flags & 2
    reader, check, size = zlib.decompressobj(-15), 0, 0
    try:
        while place < len(data) and not reader.eof:
            rest = data[place : place + 65536]
            place += len(rest)
            while rest and not reader.eof:
                out = reader.decompress(rest, 1 << 20)
                check, size, rest = zlib.crc32(out, check), size + len(out), reader.unconsumed_tail
    except zlib.error:
        return None
    end = place - len(reader.unused_data)
    return end + 8 - at if reader.eof and data[end : end + 8] == check.to_bytes(4, "little") + (size & 0xFFFFFFFF).to_bytes(4, "little") else None


def crc8(data: bytes) -> int:
    """Of a FLAC frame's header: polynomial x^8 + x^2 + x + 1."""
    value = 0
    for byte in data:
        value ^= byte
        for _ in range(8):
            value = value << 1 ^ 0x107 if value & 0x80 else value << 1
    return value


def flac(data: Bytes, at: int) -> int | None:
    """Metadata blocks by their lengths, then a frame whose header fits its check."""
    place, last = at + 4, False
    if data[place : place + 1] not in (b"\0", b"\x80") or data[place + 1 : place + 4] != b"\0\0\x22":
        return None
    while not last:
        if place + 4 > len(data):
            return None
        last = data[place] >= 128
        place += 4 + int.from_bytes(data[place + 1 : place + 4], "big")
    head = data[place : place + 16]
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        return None
    # The frame's number takes as many bytes as in UTF-8; odd block sizes and rates follow it.
    lead = head[4]
    number = 1 if lead < 0x80 else next((n for n in range(2, 8) if lead >> (7 - n) == (1 << (n + 1)) - 2), 0)
    size, rate = head[2] >> 4, head[2] & 15
    n = 4 + number + {6: 1, 7: 2}.get(size, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    return len(data) - at if number and n < len(head) and crc8(head[:n]) == head[n] else None


#: A byte with its bits in the other order.
TURNED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def ogg_check(page: bytes) -> int:
    """The page's CRC-32 counts bits from the other end than zlib's, and starts and ends plain."""
    found = zlib.crc32(page.translate(TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{found:032b}"[::-1], 2)


def ogg(data: Bytes, at: int) -> int | None:
    place = at
    while data[place : place + 4] == b"OggS" and place + 27 <= len(data):
        n = data[place + 26]
        end = place + 27 + n + sum(data[place + 27 : place + 27 + n])
        page = data[place : place + 22] + bytes(4) + data[place + 26 : end]
        if end > len(data) or ogg_check(page) != int.from_bytes(data[place + 22 : place + 26], "little"):
            break
        place = end
    return place - at if at < place else None


#: Boxes that stand at the top of a file.
BOXES = frozenset(b"ftyp moov mdat free skip wide uuid meta moof mfra sidx styp pdin ssix prft emsg".split())


def mp4(data: Bytes, at: int) -> int | None:
    """Boxes by their lengths, a movie or a picture's description among them."""
    def step(place: int) -> tuple[int, int] | None:
        kind = data[place + 4 : place + 8]
        if place < 0 or place + 8 > len(data) or kind not in BOXES:
            return None
        size = int.from_bytes(data[place : place + 4], "big")
        if size == 1 and place + 16 <= len(data):
            size = int.from_bytes(data[place + 8 : place + 16], "big")
        size = size or len(data) - place
        broken = size < 8 or place + size > len(data)
        return (len(data), 2) if broken else (place + size, kind in (b"moov", b"meta", b"moof"))

    place, seen = data.follow(mp4, at, len(data), step)
    return place - at if seen == 1 else None


#: Kilobits by MPEG version 1 or 2 and index, for layer 3 (fixed values), and samples a second.
BIT_RATES = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def mp3(data: Bytes, at: int) -> int | None:
    """An ID3 tag by its length, then three frames of layer 3 or more, each where the last one ends."""
    place, frames = at, 0
    if data[place : place + 3] == b"ID3":
        if place + 10 > len(data) or max(data[place + 6 : place + 10]) > 127:
            return None
        a, b, c, d = data[place + 6 : place + 10]
        place += 10 + (a << 21 | b << 14 | c << 7 | d)
    while place + 4 <= len(data) and data[place] == 0xFF and data[place + 1] & 0xE6 == 0xE2:
        version, rate, sample = data[place + 1] >> 3 & 3, data[place + 2] >> 4, data[place + 2] >> 2 & 3
        if version == 1 or rate in (0, 15) or sample == 3:
            break
        size = (144 if version == 3 else 72) * 1000 * BIT_RATES[1 if version == 3 else 2][rate] // SAMPLE_RATES[version][sample] + (data[place + 2] >> 1 & 1)
        if place + size > len(data):
            break
        place, frames = place + size, frames + 1
    return place - at if frames >= 3 else None


def tiff(data: Bytes, at: int) -> int | None:
    """Directories by their offsets; the file reaches to the end of the furthest directory or strip."""
    order = "little" if data[at : at + 2] == b"II" else "big"
    number = lambda place, n: int.from_bytes(data[at + place : at + place + n], order)
    end, seen, directory = 8, set(), number(4, 4)
    while directory:
        n = number(directory, 2)
        if directory in seen or len(seen) > 100 or directory < 8 or not n or at + directory + 6 + 12 * n > len(data):
            return None
        seen.add(directory)
        end, places, sizes = max(end, directory + 6 + 12 * n), [], []
        for entry in range(directory + 2, directory + 2 + 12 * n, 12):
            tag, kind, count = number(entry, 2), number(entry + 2, 2), number(entry + 4, 4)
            width = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}.get(kind, 0)
            start = entry + 8 if width * count <= 4 else number(entry + 8, 4)
            if not width or at + start + width * count > len(data):
                return None
            end = max(end, start + width * count)
            if tag in (273, 324, 279, 325):  # where strips or tiles stand, and their lengths
                (places if tag in (273, 324) else sizes).extend(number(start + width * k, width) for k in range(count))
        if not places or len(places) != len(sizes):
            return None
        end = max(end, *(a + b for a, b in zip(places, sizes, strict=True)))
        directory = number(directory + 2 + 12 * n, 4)
    return end if seen and at + end <= len(data) else None


#: Magic bytes, how far into the file they stand, type, validator.
SIGNATURES = [
    (b"RIFF", 0, "riff", riff), (b"\x89PNG\r\n\x1a\n", 0, "image/png", png), (b"GIF87a", 0, "image/gif", gif), (b"GIF89a", 0, "image/gif", gif), (b"\xff\xd8\xff", 0, "image/jpeg", jpeg), (b"BM", 0, "image/bmp", bmp), (b"II*\0", 0, "image/tiff", tiff), (b"MM\0*", 0, "image/tiff", tiff),
    (b"%PDF-", 0, "application/pdf", pdf), (b"PK\x03\x04", 0, "application/zip", zipped), (b"\x1f\x8b\x08", 0, "application/gzip", gzipped), (b"fLaC", 0, "audio/flac", flac), (b"OggS", 0, "audio/ogg", ogg), (b"ftyp", 4, "video/mp4", mp4), (b"ID3", 0, "audio/mpeg", mp3), (b"\xff\xfb", 0, "audio/mpeg", mp3), (b"\xff\xf3", 0, "audio/mpeg", mp3),
]
#: Validators that walk a chain of parts, each of which begins like the file: inside a sound one they do not look again.
CHAINS = (ogg, mp3)
RIFF_KIND = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


def magic() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, (mark, *_) in enumerate(SIGNATURES):
        found.add_word(mark.decode("latin-1"), (len(mark), k))
    found.make_automaton()
    return found


def spans(data: bytes, search: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, offset, length) of each sound file in the bytes, outer ones first; later ones may lie inside."""
    out, data, walked = [], Bytes(data), dict.fromkeys(CHAINS, 0)
    for end, (n, k) in search.iter(data.decode("latin-1")):
        _, before, kind, sound = SIGNATURES[k]
        at = end - n + 1 - before
        if at < walked.get(sound, 0):
            continue
        length = sound(data, at)
        if length:
            if sound in walked:
                walked[sound] = at + length
            out.append((RIFF_KIND[data[at + 8 : at + 12]] if kind == "riff" else kind, at, length))
    return sorted(out, key=lambda x: (x[1], -x[2]))


def to_wave(payload: bytes) -> bytes:
    """8-bit mono PCM: a sample is a byte."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def from_wave(data: bytes) -> bytes:
    """The samples of the data chunk."""
    place = 12
    while place + 8 <= len(data):
        n = int.from_bytes(data[place + 4 : place + 8], "little")
        if data[place : place + 4] == b"data":
            return data[place + 8 : place + 8 + n]
        place += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def store(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, media, declared): each text's UTF-8, filled up to whole blocks, as WAVE bytes. The type
    that is declared is the one of unknown bytes; sniffing corrects it."""

    def build():
        def row(doc_id, text):
            raw = (text or "").encode()
            return doc_id, len(raw), to_wave(raw + FILL * (-len(raw) % block or (0 if raw else block))), "application/octet-stream"

        return row

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_bytes long, media binary, declared string", build)


def sniff(df: DataFrame, key: str = "doc_id", content: str = "media", declared: str = "declared") -> DataFrame:
    """(key, detected, corrected boolean, media_bytes, spans array<struct<type, start, length>>)."""

    def build():
        search = magic()

        def row(k, data, said):
            if data is None:
                return k, None, False, None, []
            found = spans(data, search)
            kind = next((t for t, at, n in found if at == 0 and n == len(data)), None)
            return k, kind or said, kind is not None and kind != said, len(data), [{"type": t, "start": a, "length": n} for t, a, n in found if (a, n) != (0, len(data))]

        return row

    plain = df.select(F.col(key).alias("_k"), F.col(content).alias("_c"), F.col(declared).alias("_d"))
    return map_rows(plain, ["_k", "_c", "_d"], f"`{key}` long, detected string, corrected boolean, media_bytes long, spans array<struct<type string, start long, length long>>", build)


def read_back(stored: DataFrame) -> DataFrame:
    """Digest columns of what a stored column holds, read from the media bytes alone."""

    def build():
        search = magic()

        def row(doc_id, n_bytes, media, declared):
            found = spans(media, search)
            kind = next((t for t, at, n in found if at == 0 and n == len(media)), declared)
            payload = from_wave(media)
            inner = [f"{t}@{a}+{n}" for t, a, n in found if (a, n) != (0, len(media))]
            total = sum(payload)
            feature = f"{kind};samples={len(payload)};mean={total / len(payload):.4f};distinct={len(set(payload))};silence={payload.count(128)};embedded={','.join(inner)}"
            return doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

        return row

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(stored, ["doc_id", "n_bytes", "media", "declared"], schema, build)


def op4(spark, sf_dir):
    return read_back(store(table(spark, sf_dir, "documents")))

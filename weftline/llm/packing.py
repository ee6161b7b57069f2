"""Best-fit packing with certified bounds.

Documents become token ids (and a separator); only longer ones than a sequence are cut. Each partition packs its
pieces best-fit decreasing and compares its bins with a lower bound from dual feasible functions. Partitions give up
their loosest bin and, where they have a gap, the loosest bins with as much free space as the gap's bins hold. These
documents are dealt anew, into pools of no more than a first partition's size, and packed again, until the bins meet
the bound of the whole table or a round closes less than LEAST_GAIN of the gap. A round that needs more bins than
before does not count.

Defined cases: a null or empty text is the separator alone; repeated rows are packed each; a null doc_id is kept;
an empty table gives an empty table; columns other than doc_id and text are left out of the result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, table

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, SEPARATOR = 2048, 0
#: Pieces of a partition or a pool, pieces of text whose ids a task remembers (twice as
#: many at most), bytes of text that are tokenized at once.
PART_PIECES, REMEMBERED, BATCH_BYTES = 8_000, 120_000, 2_000_000
#: Part of the open gap that another round of pooling must close for one more to follow.
LEAST_GAIN = 0.05

PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Texts of characters below this one are cut here; of others, the words that have one go to the tokenizer.
PLAIN_BELOW = 0x100
#: Strings after an apostrophe that are pieces of their own (fixed pattern of the vocabulary's file).
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


#: Separators that Python and the tokenizer see differently; one of them ends words where texts have none, and its "id".
SEPARATORS, WORD_END, NO_ID = "\x1c\x1d\x1e\x1f", "\x1c", 0xFFFFFFFF


def pieces_pattern() -> re.Pattern:
    """The vocabulary's cut of lower-cased text as a pattern over characters below PLAIN_BELOW: runs of letters, single
    numbers, and runs of what is neither these nor white space."""
    below = [chr(c) for c in range(PLAIN_BELOW)]
    letters = "".join(c for c in below if unicodedata.category(c)[0] == "L")
    numbers = "".join(c for c in below if unicodedata.category(c)[0] == "N")
    others = "".join(re.escape(c) for c in below if not c.isspace() and c not in letters + numbers)
    return re.compile("|".join([*("'" + x for x in SUFFIXES), f"[{letters}]+", f"[{numbers}]", f"[{others}]+", WORD_END]))


PIECES = pieces_pattern()


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Remembered(dict):
    """Ids of pieces as little-endian bytes, by the tokenizer's model where they are new. What has not been met among
    the last REMEMBERED new pieces, or the ones before these, is forgotten."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.letters, self.before = tokenizer.model, byte_letters(), {}
        self.packed = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            raw = piece if piece.isascii() else piece.encode().decode("latin-1")
            ids = b"".join([self.packed[t.id] for t in self.model.tokenize(raw.translate(self.letters))])
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def is_plain(text: str) -> bool:
    """Whether all characters are below PLAIN_BELOW."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Token ids of whole texts. This vocabulary never joins across white space or pieces, so a batch of texts cuts each of
    its distinct words once, and the tokenizer's model sees each new piece once. Words with characters from PLAIN_BELOW
    on, where composition and case need their neighbours, go through the whole tokenizer; so does a text with special
    tokens or separators."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ids = Remembered(self.tokenizer)
        self.end_of_word = np.array([NO_ID], "<u4").tobytes()

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def words(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length): the ids of each word."""
        ended = pc.binary_join_element_wise(words, *(pa.scalar(x, pa.large_string()) for x in ("", WORD_END)))
        text = ended.buffers()[2].to_pybytes().decode() if len(words) else ""
        odd, whole = [], []
        if not is_plain(text):
            listed = words.to_pylist()
            odd = [k for k, w in enumerate(listed) if not is_plain(w)]
            whole = self.plain([listed[k] for k in odd])
            for k in odd:
                listed[k] = ""
            text = WORD_END.join([*listed, ""])
        self.ids[WORD_END] = self.end_of_word
        found = b"".join(map(self.ids.__getitem__, PIECES.findall(text.lower())))
        ids = np.frombuffer(found + b"".join(whole), "<u4")
        end = np.flatnonzero(ids == NO_ID)
        start = np.concatenate([[0], end[:-1] + 1])
        length = end - start
        length[odd] = [len(x) // 4 for x in whole]
        start[odd] = len(found) // 4 + np.cumsum(length[odd]) - length[odd]
        return ids, start, length

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out = [b""] * len(texts)
        whole = [k for k, t in enumerate(texts) if "<|" in t or any(c in t for c in SEPARATORS)]
        for k, data in zip(whole, self.plain([texts[k] for k in whole]), strict=True):
            out[k] = data
        rest = sorted(set(range(len(texts))) - set(whole))
        if not rest:
            return out
        split = pc.split_pattern(pa.array([texts[k] for k in rest], pa.large_string()), " ")
        words = split.values.dictionary_encode()
        ids, start, length = self.words(words.dictionary)
        index = words.indices.to_numpy()
        n = length[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = ids[np.repeat(start[index] - ends[:-1], n) + np.arange(ends[-1])]
        at = ends[split.offsets.to_numpy()].tolist()
        for k, a, b in zip(rest, at[:-1], at[1:], strict=True):
            out[k] = ids[a:b].tobytes()
        return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about BATCH_BYTES of text, a row at least."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
        first = 0
        while first < batch.num_rows:
            limit = BATCH_BYTES + (size[first - 1] if first else 0)
            last = max(first + 1, int(np.searchsorted(size, limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the whole documents, cut only where longer than a sequence."""
    path = tokenizer or default_tokenizer()
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path).encode
        for part in slices(batches):
            ids, texts = (c.to_pylist() for c in part.columns)
            rows = []
            for doc_id, data in zip(ids, encode([t or "" for t in texts]), strict=True):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    piece = data[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES_SQL)


def lower_bound(size: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs of size[n] items of length n, n from 0 to capacity: the best over the dual feasible functions that, for a threshold t up to half
    the capacity, count items over capacity - t as whole bins, leave out items under t and take the rest as they are;
    and over those that round items to multiples of capacity / (k + 1)."""
    count, total = np.cumsum(size), np.cumsum(size * np.arange(capacity + 1))
    t = np.arange(0, capacity // 2 + 1)
    large = count[-1] - count[capacity - t]
    middle = total[capacity - t] - np.where(t > 0, total[np.maximum(t - 1, 0)], 0)
    best = int(np.max(large - (-middle // capacity)))
    x = np.arange(capacity + 1)
    for k in range(1, 21):
        scaled = np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, int(-(-int(np.sum(size * scaled)) // (k * capacity))))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of lengths in the given (decreasing) order: (bin, offset) of each and the bins' fills.

    Open bins are grouped by free space, so an item finds the fullest bin it fits into in a search over
    at most `capacity` sorted values.
    """
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fills: list[int] = []
    by_space: dict[int, list[int]] = {}
    spaces: list[int] = []
    for i, n in enumerate(lengths.tolist()):
        at = bisect_left(spaces, n)
        if at < len(spaces):
            space = spaces[at]
            b = by_space[space].pop()
            if not by_space[space]:
                del by_space[space], spaces[at]
        else:
            b = len(fills)
            fills.append(0)
            space = capacity
        where[i], offset[i] = b, fills[b]
        fills[b] += n
        if left := space - n:
            if left not in by_space:
                by_space[left] = []
                insort(spaces, left)
            by_space[left].append(b)
    return where, offset, np.array(fills, np.int64)


PACKED_SQL = PIECES_SQL + ", sequence_id long, offset long, part long, loose boolean"


def pack_part(level: int, capacity: int):
    """Packs the pieces of one part; marks as loose the pieces of the bins that it gives up."""

    def run(key, rows):
        part = key[0].as_py()
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows.column("length").to_numpy()
        where, offset, fills = best_fit(lengths, capacity)
        gap = len(fills) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        # To save `gap` bins, as much must go into free space elsewhere: the loosest bins hold most of it.
        order = np.argsort(fills, kind="stable")
        free = capacity - fills[order]
        takes = min(len(fills), int(np.searchsorted(np.cumsum(free), gap * capacity)) + 1)
        loose = np.zeros(len(fills), bool)
        loose[order[:takes]] = fills[order[:takes]] < capacity
        number = np.int64(level) << 58 | np.int64(part) << 24 | where
        kept = rows.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        for name, column in (("sequence_id", number), ("offset", offset), ("part", np.full(len(where), part)), ("loose", loose[where])):
            kept = kept.append_column(name, pa.array(column))
        return kept

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """rows (doc_id, piece, start, length, ids_crc32) -> the same with sequence_id and offset.

    Parts are dealt by a hash of the piece and its row, so that each holds a mix of all lengths and copies spread.
    """
    rows = staged(rows, "pieces")
    size = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():  # as many rows as there are lengths
        size[length] = n
    bound, left = lower_bound(size, capacity), int(size.sum())
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kept, before, level, bins, open_bins = [], None, 0, None, None
    while True:
        parts = max(1, round(left / part_pieces))
        dealt = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row", F.lit(level)), F.lit(parts)))
        packed = staged(dealt.select(*columns[:5], "part").groupBy("part").applyInArrow(pack_part(level, capacity), PACKED_SQL), "packed")
        # Each bin has one piece at its start.
        n_bins, n_loose, left = packed.agg(*(F.coalesce(F.sum(F.expr(x).cast("long")), F.lit(0)) for x in ("offset = 0", "loose and offset = 0", "loose"))).first()
        if before is not None:
            if n_bins >= open_bins:
                return _union([*kept, before.filter("loose").select(*columns)])
            saved, gap = open_bins - n_bins, bins - bound
            bins -= saved
            done = saved < LEAST_GAIN * gap
        else:
            bins, done = n_bins, False
        if done or bins <= bound or parts == 1 or n_loose < 2:
            return _union([*kept, packed.select(*columns)])
        kept.append(packed.filter("not loose").select(*columns))
        rows, before, open_bins, level = packed.filter("loose").select(*columns[:5]), packed, n_loose, level + 1


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return whole


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, tokenizer, capacity), capacity)


def op1(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))

"""Document fingerprints: an improbable-feature digest.

Every window of 24 bytes gets a rarity rank from its entropy. In every stretch of 16 windows the leftmost rarest one
earns a point; windows with enough points are features. Features go into a chain of Bloom filters, a new one for
every 160 features, and two digests are compared by the bits their filters share beyond chance.

Entropy follows from running byte counts, so all windows of a text cost a fixed number of array passes.

Defined cases: a null or empty text has an empty digest, like itself only; a text under 24 bytes, or one without any
feature (one byte repeated), has its whole self as its only feature; repeated rows have equal digests; ties of doc_id
are ordered by a hash of their text, then by it; null ids come last; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

WINDOW, STRETCH, POINTS = 24, 16, 4
FILTER_BITS, HASHES, PER_FILTER = 2048, 5, 160
#: Entropies (bits a byte) under LOW are repetition and never features; the most common entropy of prose and
#: its spread rank the others: the farther away, the rarer.
LOW, COMMON, SPREAD = 0.5, 3.4, 0.4
#: Bytes worked at once; texts longer than this are worked in overlapping parts.
PART_BYTES = 1 << 20


def _steps() -> np.ndarray:
    """c * log2(c) - (c - 1) * log2(c - 1) in 2**20ths: what the c-th equal byte adds to a window's sum."""
    c = np.arange(WINDOW + 1, dtype=float)
    f = np.where(c > 0, c * np.log2(np.maximum(c, 1)), 0)
    return np.concatenate([[0], np.round(np.diff(f) * 2**20)]).astype(np.int64)


STEPS = _steps()


def _ranks() -> np.ndarray:
    """Rank by entropy in 64ths of a bit, 0 to 6 bits; 0 is the rarest, 1000 the commonest, 1001 never a feature."""
    h = np.arange(0, 6 * 64 + 1) / 64
    return np.where(h < LOW, 1001, np.round(1000 * np.exp(-(((h - COMMON) / SPREAD) ** 2) / 2))).astype(np.int64)


RANKS = _ranks()


def ranks(data: np.ndarray) -> np.ndarray:
    """Rank of the window that starts at each byte."""
    n = len(data)
    back = np.ones(n, np.uint8)  # equal bytes among this and the WINDOW - 1 before
    ahead = np.ones(n, np.uint8)
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        back[k:] += same
        ahead[:-k] += same
    total = int(STEPS[back[:WINDOW]].sum())
    change = STEPS[back[WINDOW:]] - STEPS[_leaving(ahead, n)]
    sums = np.concatenate([[total], total + np.cumsum(change)])
    entropy = np.log2(WINDOW) - sums / (WINDOW * 2.0**20)
    return RANKS[np.clip(np.rint(entropy * 64), 0, 384).astype(np.int64)]


def _leaving(ahead: np.ndarray, n: int) -> np.ndarray:
    return ahead[: n - WINDOW]


def features(data: bytes) -> np.ndarray:
    """Starts of a text's features, in order."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64)
    found = []
    for at in range(0, len(data) - WINDOW + 1, PART_BYTES):
        part = np.frombuffer(data, np.uint8)[max(0, at - STRETCH) : at + PART_BYTES + WINDOW + STRETCH]
        lead = at - max(0, at - STRETCH)
        rank = ranks(part)
        key = rank << 32 | np.arange(len(rank))
        low, width = key, 1
        while width < STRETCH and len(low) > width:
            step = min(width, STRETCH - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        points = np.bincount(low & 0xFFFFFFFF, minlength=len(rank))
        chosen = np.flatnonzero((points >= POINTS) & (rank <= 1000))
        chosen = chosen[(chosen >= lead) & (chosen < lead + PART_BYTES)]
        found.append(chosen - lead + at)
    return np.concatenate(found)


MIX = [np.uint64(int.from_bytes(hashlib.sha256(bytes([k])).digest()[:8], "little") | 1) for k in range(WINDOW // 8 + 2)]


def places(data: bytes, starts: np.ndarray) -> np.ndarray:
    """(feature, hash) -> bit of a filter."""
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), WINDOW)[starts]
    words = np.ascontiguousarray(windows).view("<u8")
    value = np.zeros(len(starts), np.uint64)
    for k in range(WINDOW // 8):
        value = (value ^ words[:, k]) * MIX[k]
        value ^= value >> np.uint64(29)
    value = (value ^ (value >> np.uint64(32))) * MIX[-2]
    value ^= value >> np.uint64(31)
    return np.stack([(value >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1) for k in range(HASHES)], 1).astype(np.int64)


def digest(text: str | None) -> np.ndarray:
    """The chain of filters: (filters, 2048) bits; no filter for an empty text."""
    data = (text or "").encode()
    if not data:
        return np.zeros((0, FILTER_BITS), bool)
    starts = features(data)
    if len(starts):
        bits = places(data, starts)
    else:
        value = hashlib.sha256(data).digest()
        bits = np.array([[int.from_bytes(value[4 * k : 4 * k + 4], "little") % FILTER_BITS for k in range(HASHES)]])
    chain = np.zeros((-(-len(bits) // PER_FILTER), FILTER_BITS), bool)
    chain[np.repeat(np.arange(len(bits)) // PER_FILTER, HASHES), bits.ravel()] = True
    return chain


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter of the shorter chain against its best match in the other, as the bits shared beyond what
    two unrelated filters of their fill share, over the most they could share; the mean by filled bits."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    na, nb = a.sum(1).astype(float), b.sum(1).astype(float)
    best = np.zeros(len(a))
    for start in range(0, len(a), 256):
        part = slice(start, start + 256)
        same = a[part].astype(np.float32) @ b.T.astype(np.float32)
        most = np.minimum(na[part, None], nb[None, :])
        chance = na[part, None] * nb[None, :] / FILTER_BITS
        slack = 0.3 * np.sqrt(np.maximum(chance, 1))
        best[part] = np.max(np.where(same >= most, 1.0, np.clip((same - chance - slack) / np.maximum(most - chance - slack, 1e-9), 0, 1)), axis=1)
    return float(np.clip((best * na).sum() / na.sum(), 0, 1))


def shown(chain: np.ndarray) -> str:
    """filters:features-free text form: count, then the filters in base 64."""
    return f"{len(chain)}:{base64.b64encode(np.packbits(chain, axis=None).tobytes()).decode()}"


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as much of the following text's front as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every document, without neighbours: no shuffle."""
    from .common import map_rows

    return map_rows(docs, ["doc_id", "text"], "doc_id long, fingerprint string", lambda: lambda doc_id, text: (doc_id, shown(digest(text))))


PAIRED_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each document against its edited text and the next document by descending doc_id (the last meets the first); nulls
    come last, rows of one id by a hash of their text, descending, then by the text.

    Ids are cut into ranges by quantiles, and a range's neighbour sends it a copy of its greatest document, so that
    each range can be walked in order by itself. An id that fills several ranges, and null ids, are cut further by that
    hash, so that no task takes all of them. Texts are shuffled once; of other columns only these two are read, so that
    their names cannot clash; very long texts are held two at a time.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else []
    # An id that is several quantiles has a range to itself, in as many parts and more.
    heavy = {c: 4 * n for c, n in Counter(cuts or []).items() if n > 1}
    splits = sorted({float(c) for c in cuts or []} | {float(c + 1) for c in heavy})
    if splits:
        bucketed = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol="_d", outputCol="_b").transform(ids.withColumn("_d", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))))
        where = F.col("_b").cast("int")
    else:
        bucketed, where = ids, F.lit(0)
    parts = F.when(F.col("doc_id").isNull(), 4 * ranges)
    if heavy:
        known = F.create_map(*[F.lit(x) for pair in heavy.items() for x in pair])
        parts = F.coalesce(parts, F.try_element_at(known, F.col("doc_id")))
    # The part is a range of the hash, whose order it keeps.
    part = F.floor((F.shiftright("h", 32).cast("double") + 2.0**31) / 2.0**32 * F.coalesce(parts, F.lit(1)))
    alone = F.when(parts.isNull(), 0).otherwise(part)
    bucketed = bucketed.select("doc_id", "text", "h", (F.when(F.col("doc_id").isNull(), -1).otherwise(where).cast("long") * 2**32 + alone).alias("range"))
    # One row a range: its first document's id. The range above it walks into the first document of that id.
    firsts = bucketed.groupBy("range").agg(F.max("doc_id").alias("first")).collect()
    order = sorted(firsts, key=lambda r: -r["range"])
    if not order:
        return spark.createDataFrame([], PAIRED_SQL)
    # Every range but the first is entered from the one above; the walk's very first document follows the last.
    pairs = spark.createDataFrame([(r["range"], r["first"], order[k - 1]["range"]) for k, r in enumerate(order)], "_range long, _id long, _to long")
    first = (F.col("range") == F.col("_range")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    copies = bucketed.join(F.broadcast(pairs), first).groupBy(F.col("_to").alias("range")).agg(F.max(F.struct("h", "text"))["text"].alias("text"))
    walk = bucketed.withColumn("copy", F.lit(0)).unionByName(copies.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("h"), "range", F.lit(1).alias("copy")))
    dealt = walk.repartition("range").sortWithinPartitions(F.col("range"), F.col("copy"), F.col("doc_id").desc_nulls_last(), F.col("h").desc(), F.col("text").desc())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = None  # (range, doc_id, text, chain): waits for its next document

        def done(text_next, chain_next):
            _, doc_id, text, chain = held
            other = edited(text, text_next)
            chain_other = digest(other)
            rows.append((doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), shown(chain), shown(chain_other), likeness(chain, chain_other), likeness(chain, chain_next)))

        def out():
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = [x.split()[0] for x in PAIRED_SQL.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows.clear()
            return batch

        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                for doc_id, text, where, copy in zip(*(c.to_pylist() for c in batch.slice(start, 200).columns), strict=True):
                    if copy and (held is None or held[0] != where):
                        continue  # a second copy, or a range without documents of its own
                    chain = held[3] if held is not None and held[2] == text else digest(text)
                    if held is not None and held[0] == where:
                        done(text, chain)
                    held = None if copy else (where, doc_id, text, chain)
                if rows:
                    yield out()

    return dealt.select("doc_id", "text", "range", "copy").mapInArrow(run, PAIRED_SQL)


def op8(spark, sf_dir):
    return against_next(table(spark, sf_dir, "documents"))

"""Alignment of two tokenizers over the same texts.

Both cut a text's bytes. The places where tokens of both end are the common keys of two dictionaries from end to index; in
order, they slice the two lists of ids into groups, and within a group every token of one is linked with every
token of the other. A pair of ids counts the documents that hold it linked.

How often a pair is linked over all documents takes a pass over them and a way back. Documents go in blocks of
bounded size: a task counts a block's pairs by itself and writes a document's links as places in the block's sorted
pairs. Only pairs of blocks are then counted by a shuffle and come back to their block, with what they count and whether
that is the most of their first id; a block's documents and pairs meet in one group, which is as large as a block. Nothing
is sent to all tasks, and a pair that every document has makes a row a block.

Defined cases: a null or empty text, and one whose joined tokens are not its bytes (as where the second vocabulary's
space mark stands in it), has no tokens; special tokens in texts are plain text; repeated rows are documents each; a
null doc_id is kept; an empty table gives an empty table; columns other than doc_id and text are left out, whatever
their names. A very long text is a block of its own. A group of very many tokens is counted by its distinct ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import staged, table
from .packing import slices

#: Bytes of text in a block of documents, links of a group that are listed one by one.
BLOCK_BYTES, LISTED = 8_000_000, 1_000_000


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Names:
    """Decimals of ids after the marks before a group's first, a further and its second list's first id."""

    def __init__(self, ids: int):
        self.group, self.within, self.second = 0, ids, 2 * ids
        self.marked = [f"{mark}{i}" for mark in ";,|" for i in range(ids)]


@dataclass
class Alignment:
    """Ids of both tokenizers, and how many of each are in each group."""

    a: np.ndarray
    b: np.ndarray
    a_sizes: np.ndarray
    b_sizes: np.ndarray

    def text(self, names: Names) -> str:
        """`a1,a2|b1;a3|b2,b3`: each id after its mark, put where its group has it."""
        m, n = self.a_sizes, self.b_sizes
        a_start, b_start = np.cumsum(m) - m, np.cumsum(n) - n
        a_mark, b_mark = np.full(len(self.a), names.within), np.full(len(self.b), names.within)
        a_mark[a_start], b_mark[b_start] = names.group, names.second
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + np.repeat(b_start, m)] = self.a + a_mark
        out[np.arange(len(self.b)) + np.repeat(a_start + m, n)] = self.b + b_mark
        return "".join(map(names.marked.__getitem__, out.tolist()))[1:]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, times): the distinct pairs of linked ids, first id times 2^32 plus second, in order, and their occurrences."""
        m, n = self.a_sizes, self.b_sizes
        a_start, b_start, size = np.cumsum(m) - m, np.cumsum(n) - n, m * n
        small = np.flatnonzero(size <= LISTED)
        group = np.repeat(small, size[small])
        within = np.arange(len(group)) - np.repeat(np.cumsum(size[small]) - size[small], size[small])
        pairs = [self.a[a_start[group] + within // n[group]].astype(np.int64) << 32 | self.b[b_start[group] + within % n[group]]]
        times = [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(size > LISTED):
            x, x_times = np.unique(self.a[a_start[g] : a_start[g] + m[g]], return_counts=True)
            y, y_times = np.unique(self.b[b_start[g] : b_start[g] + n[g]], return_counts=True)
            pairs.append(((x.astype(np.int64) << 32)[:, None] | y).ravel())
            times.append((x_times[:, None] * y_times).ravel())
        found, which = np.unique(np.concatenate(pairs), return_inverse=True)
        return found, np.bincount(which, np.concatenate(times), len(found)).astype(np.int64)


NOTHING = Alignment(*(np.zeros(0, np.int32),) * 2, *(np.zeros(0, np.int64),) * 2)


class Pieces:
    """Ids of whole texts by a piece vocabulary that puts a space before them, and whether their pieces are the text.

    Where no piece goes on after a space mark inside it, what stands between two single spaces is cut by itself, so a batch
    cuts each of these words once and remembers it; a text with other spaces is cut whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes_of = [bytes([int(name[3:-1], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
        self.sizes = np.array(list(map(len, self.bytes_of)), np.int64)
        self.by_words = not any("▁" in name.lstrip("▁") for name in names)
        #: ids of words, None where the pieces are not the word
        self.known: dict[str, bytes | None] = {}
        self.before: dict[str, bytes | None] = {}

    def learn(self, words: list[str]) -> dict[str, bytes | None]:
        cut = self.model.encode(words, num_threads=1)
        ids = np.array(list(chain.from_iterable(cut)), "<i4").tobytes()
        ends = np.cumsum([0, *map(len, cut)]).tolist()
        whole = [b"".join(map(self.bytes_of.__getitem__, x)) == (" " + w).encode() for w, x in zip(words, cut, strict=True)]
        return {w: ids[4 * a : 4 * b] if ok else None for w, ok, a, b in zip(words, whole, ends[:-1], ends[1:], strict=True)}

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """Little-endian 32-bit ids of each text, None where they are not its bytes."""
        if len(self.known) > bpe.REMEMBERED:
            self.before, self.known = self.known, {}
        odd = {k for k, t in enumerate(texts) if not self.by_words or not t or "  " in t or t[0] == " " or t[-1] == " "}
        split = [() if k in odd else t.split(" ") for k, t in enumerate(texts)]
        if new := set().union(*split) - self.known.keys():
            self.known |= {w: self.before[w] for w in new & self.before.keys()}
            self.known |= self.learn(list(new - self.before.keys()))
        alone = self.learn(sorted({texts[k] for k in odd})) if odd else {}
        out: list[bytes | None] = []
        for k, words in enumerate(split):
            try:
                out.append(alone[texts[k]] if k in odd else b"".join(map(self.known.__getitem__, words)))
            except TypeError:  # one of the words has no ids
                out.append(None)
        return out


class Aligner:
    def __init__(self, bytes_path: str, pieces_path: str):
        self.first, self.second = bpe.encoder_of(bytes_path, False), pieces_of(pieces_path)
        known = self.first.vocabulary.bytes_of
        self.first_sizes = np.array([len(known.get(i, b"")) for i in range(self.first.vocabulary.size)], np.int64)
        self.names = Names(max(len(self.first_sizes), len(self.second.sizes)))

    def align(self, texts: list[str | None]) -> list[Alignment]:
        whole = [k for k, t in enumerate(texts) if t]
        out = [NOTHING] * len(texts)
        firsts, seconds = self.first.encode([" " + texts[k] for k in whole]), self.second.encode([texts[k] for k in whole])
        for k, a, b in zip(whole, firsts, seconds, strict=True):
            if b is not None:
                out[k] = self.groups(np.frombuffer(a, "<i4"), np.frombuffer(b, "<i4"))
        return out

    def groups(self, a: np.ndarray, b: np.ndarray) -> Alignment:
        """Of two lists whose bytes are the same; those of a byte-level vocabulary always are the text."""
        a_at, b_at = (dict(zip(np.cumsum(sizes[x]).tolist(), count(1))) for x, sizes in ((a, self.first_sizes), (b, self.second.sizes)))
        common = sorted(a_at.keys() & b_at.keys())
        ends_of = lambda at: np.fromiter(map(at.__getitem__, common), np.int64, len(common))
        return Alignment(a, b, *(np.diff(ends_of(at), prepend=0) for at in (a_at, b_at)))


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """One for all tasks of a worker."""
    return Pieces(path)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, np.int32)]).astype(kind.to_pandas_dtype()), kind))


ALIGNED_SQL = "doc_id long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"


def align(docs: DataFrame, bytes_path: str | None = None, pieces_path: str | None = None) -> DataFrame:
    """ALIGNED_SQL: ids of both tokenizers and the sizes of the groups they fall into."""
    paths = bytes_path or bpe.default_vocabulary(), pieces_path or default_pieces()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*paths)
        for part in slices(batches):
            found = aligner.align(part.column(1).to_pylist())
            columns = [lists([getattr(x, name) for x in found], pa.int32()) for name in ("a", "b", "a_sizes", "b_sizes")]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "a_ids", "b_ids", "a_sizes", "b_sizes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED_SQL)


FIGURES = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
LINKED = pa.schema([("block", pa.int64()), ("is_document", pa.bool_()), *FIGURES, ("links", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("documents", pa.list_(pa.int32()))])
LINKED_SQL = "block long, is_document boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>, times array<int>, pairs array<long>, documents array<int>"


def linked(docs: DataFrame, bytes_path: str | None = None, pieces_path: str | None = None) -> DataFrame:
    """LINKED_SQL: a row a document with its links as places in its block's pairs, and a row a block with its pairs and
    the documents of the block that hold them."""
    paths = bytes_path or bpe.default_vocabulary(), pieces_path or default_pieces()

    def block_rows(number: int, rows: list[tuple], links: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        pairs, place, documents = np.unique(np.concatenate([p for p, _ in links]), return_inverse=True, return_counts=True)
        ends = np.cumsum([0, *(len(p) for p, _ in links)]).tolist()
        places = [place[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), FIGURES, strict=True)]
        n, no = len(rows), lambda t, k=1: pa.nulls(k, t)
        yield pa.RecordBatch.from_arrays([pa.array([number] * n), pa.array([True] * n), *columns, lists(places, pa.int32()), lists([t for _, t in links], pa.int32()), no(LINKED.field("pairs").type, n), no(LINKED.field("documents").type, n)], schema=LINKED)
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([False]), *(no(t) for _, t in FIGURES), no(LINKED.field("links").type), no(LINKED.field("times").type), lists([pairs], pa.int64()), lists([documents], pa.int32())], schema=LINKED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, number = Aligner(*paths), TaskContext.get().partitionId() << 32
        rows, links, size = [], [], 0
        for part in slices(batches):
            ids, texts = (c.to_pylist() for c in part.columns)
            for doc_id, x in zip(ids, aligner.align(texts), strict=True):
                links.append(x.links())
                digest = hashlib.sha256(x.text(aligner.names).encode()).hexdigest() if len(x.a) else ""
                rows.append((doc_id, len(x.a), len(x.b), len(x.a_sizes), int(links[-1][1].sum()), digest))
            size += part.nbytes
            if size >= BLOCK_BYTES:
                yield from block_rows(number, rows, links)
                rows, links, size, number = [], [], 0, number + 1
        if rows:
            yield from block_rows(number, rows, links)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, LINKED_SQL)


SCORED_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def score_block(documents: pa.Table, pairs: pa.Table) -> pa.Table:
    """SCORED_SQL of a block's documents by the counts of its pairs."""
    pairs = pairs.sort_by("pair")
    count, best = pairs.column("n").to_numpy(), pairs.column("best").to_numpy().astype(np.int64)
    links, times = (documents.column(c).combine_chunks() for c in ("links", "times"))
    ends = links.offsets.to_numpy().astype(np.int64) - links.offsets[0].as_py()
    place, often = links.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)

    def summed(values: np.ndarray) -> pa.Array:
        before = np.concatenate([[0], np.cumsum(values[place] * often)])
        return pa.array(before[ends[1:]] - before[ends[:-1]])

    figures = {name: documents.column(name) for name, _ in FIGURES} | {"n_best": summed(best), "count_sum": summed(count)}
    return pa.table({name: figures[name] for name in (c.split()[0] for c in SCORED_SQL.split(", "))})


def pair_counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((block, pair), (pair, n, best)) of what `linked` gives: n documents over all blocks hold the pair; best where no pair of
    its first id has more."""
    own = rows.filter("not is_document").select("block", F.explode(F.arrays_zip("pairs", "documents")).alias("x")).select("block", "x.pairs", "x.documents")
    count = staged(own.groupBy(F.col("pairs").alias("pair")).agg(F.sum("documents").alias("n")), "pair-counts")
    first = F.shiftright("pair", 32).alias("first")
    most = count.groupBy(first).agg(F.max("n").alias("most"))
    judged = count.withColumn("first", first).join(most, "first").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return own.select("block", F.col("pairs").alias("pair")), judged


def scored(rows: DataFrame) -> DataFrame:
    """SCORED_SQL of the documents that `linked` gives: links that are their first id's most frequent ones, and the sum of
    the counts of all links."""
    own, judged = pair_counts(rows)
    back = own.join(judged, "pair").select(F.col("block").alias("pair_block"), "pair", "n", "best")
    documents = rows.filter("is_document").select("block", *[name for name, _ in FIGURES], "links", "times")
    return documents.groupBy("block").cogroup(back.groupBy("pair_block")).applyInArrow(lambda a, b: score_block(a, b), SCORED_SQL)


def op11(spark, sf_dir):
    return scored(staged(linked(table(spark, sf_dir, "documents")), "linked"))

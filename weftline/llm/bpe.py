"""Byte-level BPE by speculation: greedy tokens first, merging only where they are wrong.

Words (the vocabulary's own cut of a text) are cut greedily, the longest token first, by one scan of an automaton over
all new words of a batch. A cut is what merging gives exactly if every two neighbours of it are: whether two tokens
can stand side by side is answered for all distinct pairs of a batch at once, in columns. Only words with a pair that
cannot are merged by rank. `encode` and `decode` take and give DataFrames; the query digests what they return.

Two tokens can stand side by side unless, while they grow from their bytes, the last part of the left one and the first
part of the right one are both there and would merge before either is used up. Parts and ranks come from the merges.
This needs a vocabulary in which each token has one merge, of a later rank than those of its parts, and is what merging
gives for its own bytes; words of any other vocabulary are all merged.

Defined cases: a null or empty text has no ids; a special token in a text is its id, and text again when decoded, unless
`specials` is off; repeated rows are each encoded; a null doc_id is kept; an empty table gives an empty table; columns
other than doc_id and text are left out, whatever their names. Very long texts go in blocks that end before white space,
where no word reaches across; a single word of a million characters takes one scan, or as many merges as it has. Ids
that a vocabulary lacks, and null ones, are skipped in decoding; a null list is an empty text.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .packing import PLAIN_BELOW, byte_letters, is_plain, slices

#: Fixed pattern of byte-level vocabularies: how a text is cut into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ANY_WORDS = regex.compile(WORDS)
#: Words whose ids a worker remembers (twice as many at most), the bytes of these ids, and characters of a text that are cut at once.
REMEMBERED, REMEMBERED_BYTES, BLOCK = 250_000, 16_000_000, 1_000_000
#: Ends a word in the scan; bytes are the characters below it.
WORD_END = "Ā"
NO_RANK = np.iinfo(np.int64).max
#: Bytes of a word up to which it is merged in step with others; longer ones by a queue each.
SHORT = 100


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def plain_words() -> re.Pattern:
    """The same for texts of characters below PLAIN_BELOW, with their classes written out; words of letters, which no other
    kind begins like, first."""
    below = [chr(c) for c in range(PLAIN_BELOW)]
    of = lambda kind: "".join(re.escape(c) for c in below if regex.match(kind, c))
    letters, numbers, blank = of(r"\p{L}"), of(r"\p{N}"), of(r"\s")
    return re.compile(f" ?[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{numbers}]+| ?[^{blank}{letters}{numbers}]+|[{blank}]+(?![^{blank}])|[{blank}]+")


PLAIN_WORDS = plain_words()


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        kind, model = content["pre_tokenizer"] or {}, content["model"]
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or content["normalizer"] or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level vocabulary")
        if any(t[flag] for t in content["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens that take in their neighbours")
        self.path = path
        byte_of = {ord(letter): chr(b) for b, letter in byte_letters().items()}
        self.id_of = {token.translate(byte_of): i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.bytes_of = {i: token.encode("latin-1") for token, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        self.size = n = max(self.bytes_of) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        parts = np.array([[model["vocab"][a], model["vocab"][b], model["vocab"][a + b]] for a, b in merges], np.int64).reshape(-1, 3)
        #: merge rank, left and right part of each token; -1 of single bytes
        self.rank, self.left, self.right = (np.full(n, -1, np.int64) for _ in range(3))
        self.rank[parts[:, 2]], self.left[parts[:, 2]], self.right[parts[:, 2]] = np.arange(len(parts)), parts[:, 0], parts[:, 1]
        keys = parts[:, 0] * n + parts[:, 1]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order
        self.merge_of = {key: (k, made) for k, (key, made) in enumerate(zip(keys.tolist(), parts[:, 2].tolist(), strict=True))}
        self.product = parts[:, 2]
        self.single = single = np.array([self.id_of[chr(b)] for b in range(256)])
        whole = np.array(list(self.id_of.values()))
        later = (self.rank[parts[:, 2]] > self.rank[parts[:, 0]]) & (self.rank[parts[:, 2]] > self.rank[parts[:, 1]])
        made = np.setdiff1d(whole, single)
        self.sound = bool(len(np.unique(parts[:, 2])) == len(parts) and later.all() and (self.rank[single] == -1).all() and (self.rank[made] >= 0).all())
        self.sound = self.sound and bool(self.side_by_side(self.left[made], self.right[made], made=True).all())

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NO_RANK where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK)

    def side_by_side(self, a: np.ndarray, b: np.ndarray, made: bool = False) -> np.ndarray:
        """Whether merging leaves each a[k] and b[k] as they are when they are neighbours; with made, up to the merge
        that joins the two.

        Goes back in time from the two tokens to their bytes: the part made last is taken apart, and the parts that
        then face each other must not merge before they are used. Of equal ranks the left one is used first.
        """
        good = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), a.copy(), b.copy()
        x_used, y_used = np.full(len(a), NO_RANK), np.full(len(a), NO_RANK)
        top = made
        while len(at):
            if not top:
                rank = self.pair_rank(x, y)
                crossed = (rank < x_used) & (rank <= y_used) & (rank != NO_RANK)
                good[at[crossed]] = False
            else:
                crossed = np.zeros(len(at), bool)
            top = False
            go = ~crossed & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            at, x, y, x_used, y_used = at[go], x[go], y[go], x_used[go], y_used[go]
            on_left = self.rank[x] > self.rank[y]
            x_used, y_used = np.where(on_left, self.rank[x], x_used), np.where(on_left, y_used, self.rank[y])
            x, y = np.where(on_left, self.right[x], x), np.where(on_left, y, self.left[y])
        return good

    def merged(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of words (bytes as characters) by their merges, lowest rank first, left before right.

        Short words go in step: each round makes the next merge of every word.
        """
        out = [b""] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= SHORT]
        data, at = self.merged_in_step([words[k] for k in short])
        for k, a, b in zip(short, at[:-1], at[1:], strict=True):
            out[k] = data[a:b]
        for k, w in enumerate(words):
            if len(w) > SHORT:
                out[k] = np.array(self.merged_by_queue([self.id_of[c] for c in w]), "<i4").tobytes()
        return out

    def merged_in_step(self, words: list[str]) -> tuple[bytes, list[int]]:
        """(ids of all words, places where words begin and end in them)"""
        ids = self.single[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))

        def ranks(at: np.ndarray) -> np.ndarray:
            after = np.minimum(at + 1, len(ids) - 1)
            return np.where((after > at) & (word[after] == word[at]), self.pair_rank(ids[at], ids[after]), NO_RANK)

        done, rank = [], ranks(np.arange(len(ids)))
        while len(ids):
            begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.append(begins, len(ids))))
            going = best < NO_RANK
            done.append((word[~going], ids[~going]))
            ids, word, rank, best = ids[going], word[going], rank[going], best[going]
            hit = np.flatnonzero(rank == best)
            hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])] if len(hit) else hit
            ids[hit] = self.product[rank[hit]]
            ids, word, rank = (np.delete(x, hit + 1) for x in (ids, word, rank))
            hit = hit - np.arange(len(hit))
            left = hit[hit > 0] - 1
            rank[hit], rank[left] = ranks(hit), ranks(left)
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (word, ids)
        order = np.argsort(word, kind="stable")
        return ids[order].astype("<i4").tobytes(), (4 * np.searchsorted(word[order], np.arange(len(words) + 1))).tolist()

    def merged_by_queue(self, ids: list[int | None]) -> list[int]:
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if (found := self.merge_of.get(ids[i] * self.size + ids[j])) is not None:
                heapq.heappush(queue, (found[0], i, found[1], ids[i], ids[j]))

        for i in range(len(ids) - 1):
            offer(i, i + 1)
        while queue:
            _, i, made, a, b = heapq.heappop(queue)
            j = after[i]
            if j >= len(ids) or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = made, None
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return [i for i in ids if i is not None]


class Encoder:
    """Ids of whole texts; `merged_words` of `new_words` had to be merged."""

    def __init__(self, path: str, specials: bool = True):
        import ahocorasick
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(path)
        self.library_cut = Tokenizer.from_file(path).pre_tokenizer
        self.longest = ahocorasick.Automaton()
        for token, i in self.vocabulary.id_of.items():
            self.longest.add_word(token, i)
        self.longest.make_automaton()
        self.special = sorted(self.vocabulary.special, key=len, reverse=True) if specials else []
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        #: ids of words; what was met before the last REMEMBERED ones is forgotten
        self.ids: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = self.new_words = self.merged_words = 0

    def cut(self, text: str) -> list[str]:
        """Words of a text. Characters that Unicode tables of different age may class differently are left to the
        library's cut, with the text around them."""
        if is_plain(text):
            pattern = PLAIN_WORDS
        elif any(c > "\x7f" and unicodedata.category(c) == "Cn" for c in set(text)):
            return [text[a:b] for _, (a, b) in self.library_cut.pre_tokenize_str(text)]
        else:
            pattern = ANY_WORDS
        if len(text) <= BLOCK:
            return pattern.findall(text)
        return [w for block in blocks(text) for w in pattern.findall(block)]

    def learn(self, words: list[str]) -> None:
        """Remember the ids of new words: propose, verify, merge what fails."""
        v = self.vocabulary
        raw = [w if w.isascii() else w.encode().decode("latin-1") for w in words]
        self.new_words += len(words)
        failed = range(len(words))
        if v.sound:
            scan = np.fromiter(chain.from_iterable(self.longest.iter_long(WORD_END.join(raw))), np.int64).reshape(-1, 2)
            ids = scan[:, 1].copy()
            word_end = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
            word = np.searchsorted(word_end, scan[:, 0], side="right")
            inner = np.flatnonzero(word[1:] == word[:-1])
            pairs, which = np.unique(ids[inner] * v.size + ids[inner + 1], return_inverse=True)
            good = v.side_by_side(pairs // v.size, pairs % v.size)
            failed = np.unique(word[inner[~good[which]]]).tolist()
            data, at = ids.astype("<i4").tobytes(), (4 * np.searchsorted(word, np.arange(len(raw) + 1))).tolist()
            for w, a, b in zip(words, at[:-1], at[1:], strict=True):
                self.ids[w] = data[a:b]
            self.held += len(data)
        for k, data in zip(failed, v.merged([raw[k] for k in failed]), strict=True):
            self.ids[words[k]] = data
            self.held += len(data)
        self.merged_words += len(failed)

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """By the words of each text."""
        cut = list(map(self.cut, texts))
        if new := set().union(*cut) - self.ids.keys():
            self.ids |= {w: self.before[w] for w in new & self.before.keys()}
            self.learn(list(new - self.before.keys()))
        return [b"".join(map(self.ids.__getitem__, words)) for words in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.ids) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.before, self.ids, self.held = self.ids, {}, 0
        special = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        if not special:
            return self.encode_plain(texts)
        out = [b""] * len(texts)
        plain = sorted(set(range(len(texts))) - set(special))
        for k, x in zip(plain, self.encode_plain([texts[k] for k in plain]), strict=True):
            out[k] = x
        for k in special:
            split = self.special_pattern.split(texts[k])
            found = iter(self.encode_plain(split[::2]))
            out[k] = b"".join(self.vocabulary.special[x].to_bytes(4, "little") if j % 2 else next(found) for j, x in enumerate(split))
        return out


@lru_cache(maxsize=2)
def encoder_of(path: str, specials: bool) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path, specials)


def blocks(text: str) -> Iterator[str]:
    """The text in blocks of about BLOCK characters that end where white space begins: no word goes on there."""
    begins, start = regex.compile(r"(?<=\S)\s"), 0
    while start < len(text):
        found = begins.search(text, start + BLOCK)
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


def encode(docs: DataFrame, path: str | None = None, specials: bool = True) -> DataFrame:
    """(doc_id, ids): the token ids of each text."""
    path = path or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, specials)
        for part in slices(batches):
            found = encoder.encode([t or "" for t in part.column(1).to_pylist()])
            ends = np.cumsum([0, *(len(x) // 4 for x in found)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


class Decoder:
    def __init__(self, path: str):
        known = Vocabulary(path).bytes_of
        size = np.array([len(known.get(i, b"")) for i in range(max(known) + 2)])
        #: bytes of all tokens, where each begins and how many it has; the last one stands for unknown ids
        self.data = np.frombuffer(b"".join(known.get(i, b"") for i in range(len(size))), np.uint8)
        self.size, self.start = size, np.cumsum(size) - size

    def decode(self, ids: pa.ListArray) -> list[str]:
        """Texts of lists of ids."""
        flat = ids.flatten().fill_null(-1).to_numpy()
        flat = np.where((flat < 0) | (flat >= len(self.size)), len(self.size) - 1, flat)
        size = self.size[flat]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.data[np.repeat(self.start[flat] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        at = ends[np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())])].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) with `text`, what the ids stand for; broken UTF-8 becomes replacement characters."""
    path = path or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoder.decode(part.column(1)), pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def op13(spark, sf_dir):
    rows = decode(encode(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(c, 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest("text").alias("decoded_sha256"))

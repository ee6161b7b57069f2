"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set is its distinct 5-word shingles. Tokens have one global order, rare before frequent. A document
of n shingles that must share `need` of them keeps a prefix of n - need + l tokens, and a partner must share l of
the prefix's tokens before the pair is verified. l grows with the candidates that the prefix would bring.

How it runs:
1. Tasks turn slices of documents into hashed shingles and deal them out by hash range, packed as binary arrays.
   A shingle that a slice has in several documents goes once with its count; which documents stays with the slice.
2. Each range sums in how many documents a shingle occurs and sends those of two and more documents back to
   their slice. A document that shares fewer than `need` shingles with anyone has no link and leaves here.
3. Equal sets collapse into classes. In each prefix token's list the class with the largest shared part is the
   leader; every other class is verified against the leader it shares most lists with. Links make groups.
4. Pairs of one group need no look. Across groups, the class of the smaller group looks for those of the larger, in
   every list that has both, so that a pair's lists are counted in one place. What has enough of them, and passes
   the bounds from lengths, places and classes both have met, is verified: no link is lost.

Exact up to collisions of hashes: token ids are the first 46 bits or more of a 64-bit hash, set ids 128 bits of two
sums over the set.

Defined cases: a null text, or one without words, has an empty set and links with nothing; a text of fewer than
five words has its whole word sequence as its only shingle; repeated rows are separate documents of one class;
a null doc_id takes part, but no component is named by it (a component of null ids only has a null name); an
empty table gives an empty table; other columns are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import components

from .common import staged, table

N = 5
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Bytes of text in a slice, and bytes of text for each hash range (64 ranges at least).
SLICE_BYTES, RANGE_BYTES, LEAST_BITS = 1_000_000, 64_000_000, 6
REST_BITS = 40
#: Members of a list that travel together, and members of the longest list from which a class's partners are counted in
#: several parts.
BLOCK, PART_MEMBERS = 512, 8192
#: In place of a document: the slice has the shingle in several.
SEVERAL = 0xFFFF

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANK = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SEEDS = mixed(np.arange(1, 300, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BYTE, PLACE = SEEDS[:256], SEEDS[256 : 256 + 16] | np.uint64(1)
STEP = np.uint64(0xD1342543DE82EF95)
STEP_BACK = np.uint64(pow(int(STEP), -1, 2**64))


class Powers:
    """Powers of STEP and its inverse, made once a task."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int):
        if len(self.up) < n:
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, STEP)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, STEP_BACK)]), dtype=np.uint64)
        return self.up[:n], self.down


def shingles(texts: list[str | None], powers: Powers, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, doc): the distinct shingle hashes of each text, sorted within it, and the text each belongs to."""
    parts = [(t or "").encode().translate(LOWER) for t in texts]
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    blank = BLANK[data]
    change = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, end = change[::2], change[1::2]
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    up, down = powers.to(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum(BYTE[data] * up, dtype=np.uint64)])
    word = mixed((total[end] - total[start]) * down[start])
    ends = np.cumsum([len(p) + 1 for p in parts])
    doc = np.searchsorted(ends, start, side="right")
    full = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.empty(0, np.int64)
    value = np.zeros(len(full), np.uint64)
    for k in range(n):
        value += word[full + k] * PLACE[k]
    per_doc = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
    values, owners = [mixed(value)], [doc[full]]
    for m in range(1, n):
        short = np.flatnonzero(per_doc == m)
        value = np.full(len(short), PLACE[n + m])
        for k in range(m):
            value += word[first[short] + k] * PLACE[k]
        values.append(mixed(value))
        owners.append(short)
    tokens, doc = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(doc, kind="stable")
    tokens, doc = tokens[order], doc[order]
    at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            tokens[a:b].sort()
    new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1])])
    return tokens[new], doc[new]


def need_of(n: np.ndarray) -> np.ndarray:
    """The least number of its own shingles that a set of n shares with any set it links to."""
    return (PERCENT * n + 99) // 100


DEALT_SQL = "range int, src long, token binary, extra binary, doc binary, several binary, ids array<long>, n array<int>, d1 array<long>, d2 array<long>"
DEALT = pa.schema(
    [("range", pa.int32()), ("src", pa.int64()), *((c, pa.binary()) for c in ("token", "extra", "doc", "several")), ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("d1", pa.list_(pa.int64())), ("d2", pa.list_(pa.int64()))]
)
DOCS_SQL = "doc_id long, n int, d1 long, d2 long, tokens array<long>, l int, prefix int"


def dealt_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), DEALT, strict=True)], schema=DEALT)


def deal(bits: int):
    """Step 1: rows (range, slice, tokens, documents, counts of those in several), and a row for each slice with its
    documents and the (token, document) of what it has several times."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, part, count = Powers(), TaskContext.get().partitionId(), 0

        def out(ids: list, texts: list) -> pa.RecordBatch:
            nonlocal count
            src = part << 32 | count
            count += 1
            tokens, doc = shingles(texts, powers)
            n = np.bincount(doc, minlength=len(texts))
            sums = []
            for salt in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D):
                total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(tokens ^ np.uint64(salt)), dtype=np.uint64)])
                at = np.concatenate([[0], np.cumsum(n)])
                sums.append(mixed(total[at[1:]] - total[at[:-1]]).view(np.int64))
            order = np.argsort(tokens, kind="stable")
            tokens, doc = tokens[order] >> np.uint64(64 - bits - REST_BITS), doc[order].astype(np.uint16)
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.empty(0, np.int64)
            times = np.diff(np.concatenate([first, [len(tokens)]]))
            again = np.repeat(times > 1, times)
            own = tokens[again].tobytes(), doc[again].tobytes()
            tokens, doc = tokens[first], np.where(times > 1, np.uint16(SEVERAL), doc[first]).astype(np.uint16)
            which = (tokens >> np.uint64(REST_BITS)).astype(np.int64)
            rest = tokens & np.uint64((1 << REST_BITS) - 1)
            low, high = rest.astype(np.uint32), (rest >> np.uint64(32)).astype(np.uint8)
            at = np.searchsorted(which, np.arange((1 << bits) + 1))
            ranges = np.flatnonzero(np.diff(at)).tolist()
            rows = []
            for r in ranges:
                of = slice(at[r], at[r + 1])
                several = times[of][times[of] > 1].astype(np.uint16)
                rows.append((r, src, low[of].tobytes(), high[of].tobytes(), doc[of].tobytes(), several.tobytes(), None, None, None, None))
            rows.append(((1 << bits) + src % (1 << bits), src, own[0], None, own[1], None, ids, n.tolist(), sums[0].tolist(), sums[1].tolist()))
            return dealt_rows(rows)

        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in ((i, t) for at in range(0, batch.num_rows, 200) for i, t in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True)):
                if texts and (size + len(text or "") > SLICE_BYTES or len(texts) == 65_535):
                    yield out(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text or "")
        if texts:
            yield out(ids, texts)

    return run


def arrays(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def count_range(bits: int):
    """Step 2: of a range, the tokens of two documents and more, with a class of their document count, by slice."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.cast(DEALT)
        if not rows.num_rows or rows.column("range")[0].as_py() >= 1 << bits:
            return rows
        high = np.uint64(rows.column("range")[0].as_py())
        low, extra, doc = arrays(rows.column("token"), np.uint32), arrays(rows.column("extra"), np.uint8), arrays(rows.column("doc"), np.uint16)
        at = np.cumsum([0, *map(len, low)])
        token = np.concatenate(low).astype(np.uint64) | np.concatenate(extra).astype(np.uint64) << np.uint64(32)
        doc = np.concatenate(doc)
        times = np.ones(len(token))
        times[doc == SEVERAL] = np.concatenate(arrays(rows.column("several"), np.uint16))
        _, inverse = np.unique(token, return_inverse=True)
        df = np.bincount(inverse, weights=times)[inverse]
        token |= high << np.uint64(REST_BITS)
        level = np.round(8 * np.log2(df)).astype(np.uint16)
        out = []
        for k, src in enumerate(rows.column("src").to_pylist()):
            part = slice(at[k], at[k + 1])
            keep = df[part] > 1
            if keep.any():
                out.append((0, src, token[part][keep].tobytes(), level[part][keep].tobytes(), doc[part][keep].tobytes(), None, None, None, None, None))
        return pa.Table.from_batches([dealt_rows(out)]) if out else DEALT.empty_table()

    return run


def settle(rows: pa.Table) -> pa.Table:
    """Step 2, back at a slice: each document with its shared tokens, rare ones first, its l and prefix length.
    tokens is null where no link is possible."""
    rows = rows.cast(DEALT)
    shared = rows.filter(pc.is_valid(rows.column("extra")))
    about = rows.filter(pc.is_valid(rows.column("ids"))).to_pylist()[0]
    join = lambda name, kind: np.concatenate([np.empty(0, kind), *arrays(shared.column(name), kind)])
    token, level, doc = join("token", np.uint64), join("extra", np.uint16), join("doc", np.uint16)
    # What the slice has in several documents came once: give it to each of them.
    own, owner = np.frombuffer(about["token"], np.uint64), np.frombuffer(about["doc"], np.uint16)
    many, one = np.flatnonzero(doc == SEVERAL), doc != SEVERAL
    many = many[np.argsort(token[many])]
    token, level, doc = np.concatenate([token[one], own]), np.concatenate([level[one], level[many][np.searchsorted(token[many], own)]]), np.concatenate([doc[one], owner])
    order = np.lexsort((token, level, doc))
    token, level, doc = token[order].view(np.int64), level[order], doc[order]
    n = np.array(about["n"], np.int64)
    have = np.bincount(doc, minlength=len(n))
    need = need_of(n)
    alive = (n > 0) & (have >= need)
    at = np.concatenate([[0], np.cumsum(have)])
    tokens, ls, prefixes = [], [], []
    for i in range(len(n)):
        if not alive[i]:
            tokens.append(None)
            ls.append(None)
            prefixes.append(None)
            continue
        base = int(have[i] - need[i] + 1)
        cost = float(np.sum(np.exp2(level[at[i] : at[i] + base] / 8.0) - 1))
        l = 1 + min(int(np.log2(1 + cost / n[i])), int(need[i]) - 1)  # noqa: E741
        tokens.append(token[at[i] : at[i + 1]])
        ls.append(l)
        prefixes.append(base + l - 1)
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32()]
    columns = [about["ids"], about["n"], about["d1"], about["d2"], tokens, ls, prefixes]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n", "d1", "d2", "tokens", "l", "prefix"])


def shared_sets(docs: DataFrame) -> DataFrame:
    """Steps 1 and 2, stored: (doc_id, n, d1, d2, tokens, l, prefix)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(LEAST_BITS, int(np.ceil(np.log2(max(1, size / RANGE_BYTES)))))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(deal(bits), DEALT_SQL)
    counted = dealt.groupBy("range").applyInArrow(count_range(bits), DEALT_SQL)
    return staged(counted.groupBy("src").applyInArrow(settle, DOCS_SQL), "shingle-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, same, linked) for the pairs (a, b) of classes: the size of their intersection and whether they link."""
    one = sets.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    two = sets.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    both = pairs.select("a", "b").join(one, "b").join(two, "a")
    same = F.size(F.array_intersect("ta", "tb"))
    return both.select("a", "b", "na", "nb", same.alias("same")).select("a", "b", "same", F.expr(f"100 * same >= {PERCENT} * (na + nb - same)").alias("linked"))


def least_same(na: str, nb: str) -> str:
    """SQL for the least intersection with which sets of na and nb shingles link."""
    whole = 100 + PERCENT
    return f"(({PERCENT} * ({na} + {nb}) + {whole - 1}) div {whole})"


#: Whether x can link with the row's class: its length and what either shares with anyone; what can still be shared
#: before and behind this token in the common order; and, for a class p that both have met (same y.i and z.i of p's
#: tokens), no more than the less of these and the less of what either shares outside of p.
POSSIBLE = f"""
{least_same("n", "x.n")} <= least(k, x.k, n, x.n)
and {least_same("n", "x.n")} <= least(at, x.at) + 1 + least(k - at - 1, x.k - x.at - 1)
and not exists(met, y -> exists(x.met, z -> z.p = y.p and {least_same("n", "x.n")} > least(y.i, z.i) + least(k - y.i, x.k - z.i)))
"""


def leaders(known: DataFrame, sets: DataFrame, outside: bool) -> DataFrame:
    """(a, b, same, linked): each class with the leader that it shares most lists with. A list's leader is the class that
    shares the largest part of itself; `outside`: of those that are not in the list's largest group."""
    rank = F.struct((F.col("k") / F.col("n")).alias("r"), (-F.col("n")).alias("n"), F.col("c").alias("c"), F.col("k").alias("k"), F.col("g").alias("g"))
    groups = known.groupBy("t", "g").agg(F.count("*").alias("m"), F.max(rank).alias("top"))
    whole = groups.groupBy("t").agg(F.max(F.struct("m", "g")).alias("big"), F.max("top").alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    if outside:
        whole = groups.join(whole.select("t", F.col("big.g").alias("bg")), "t").filter("g <> bg").groupBy("t").agg(F.max("top").alias("top"))
    leader = whole.select("t", F.col("top.c").alias("b"), (-F.col("top.n")).alias("nb"), F.col("top.k").alias("kb"), F.col("top.g").alias("gb"))
    met = known.join(leader, "t").filter(f"c <> b and g <> gb and {least_same('n', 'nb')} <= least(k, kb, n, nb)")
    best = met.groupBy("c", "b").agg(F.count("*").alias("m")).groupBy("c").agg(F.max_by("b", F.struct("m", "b")).alias("b"))
    return staged(verified(best.select(F.col("c").alias("a"), "b"), sets), "leader-pairs")


def multi_match(rows: pa.Table) -> pa.Table:
    """Of a class, the partners that share as many prefix tokens as the lesser l of the two asks for."""
    b = np.concatenate([np.asarray(x, np.int64) for x in rows.column("b").to_pylist()])
    l = np.concatenate([np.asarray(x, np.int64) for x in rows.column("lb").to_pylist()])  # noqa: E741
    partner, first, count = np.unique(b, return_index=True, return_counts=True)
    enough = partner[count >= np.minimum(l[first], rows.column("l")[0].as_py())]
    return pa.table({"a": pa.array([rows.column("c")[0].as_py()], pa.int64()), "b": pa.array([enough], pa.list_(pa.int64()))})


def link_classes(sets: DataFrame) -> DataFrame:
    """Steps 3 and 4 over classes (c, n, k, l, prefix, tokens): (id, label) of the classes that link with another."""
    every = sets.select("c", "n", "k", "l", F.posexplode(F.slice("tokens", 1, F.col("prefix"))).alias("at", "t"))
    often = every.groupBy("t").agg(F.count("*").alias("m")).filter("m > 1").select("t")
    lists = staged(every.join(often, "t"), "prefix-lists")
    first = leaders(lists.withColumn("g", F.col("c")), sets, outside=False)
    # Groups so far: a class goes with its leader, and the leader with its own. Same group, same component.
    up = first.filter("linked").select(F.col("a").alias("c"), F.col("b").alias("g"))
    up = up.join(up.select(F.col("c").alias("g"), F.col("g").alias("gg")), "g", "left").select("c", F.coalesce("gg", "g").alias("g"))
    sizes = up.groupBy("g").agg((F.count("*") + 1).alias("s"))
    up = staged(up.join(sizes, "g").select("c", "g", "s").union(sizes.select(F.col("g").alias("c"), "g", "s").join(up, "c", "left_anti")), "groups")
    known = staged(lists.join(up, "c", "left").withColumn("g", F.coalesce("g", "c")).withColumn("s", F.coalesce("s", F.lit(1))), "prefix-lists-known")
    seen = first.union(leaders(known, sets, outside=True))
    # The rest, exactly: each class against the members of larger groups, in all lists that have both.
    groups = known.groupBy("t", "g").agg(F.count("*").alias("m"), F.first("s").alias("s"))
    mixed_lists = staged(groups.groupBy("t").agg(F.max(F.struct("s", "g"))["g"].alias("top"), F.sum("m").alias("all"), F.count("*").alias("parts")).filter("parts > 1").drop("parts"), "mixed-lists")
    longest = mixed_lists.agg(F.max("all")).first()[0] or 0
    parts = 1 << max(0, int(np.ceil(np.log2(max(1, longest / PART_MEMBERS)))))
    own = seen.select(F.col("b").alias("c")).distinct().join(sets.select("c", F.col("k").alias("same")), "c").select("c", F.col("c").alias("p"), "same")
    met = seen.select(F.col("a").alias("c"), F.col("b").alias("p"), "same").union(own).groupBy("c").agg(F.collect_list(F.struct("p", F.col("same").alias("i"))).alias("met"))
    members = known.join(mixed_lists, "t").join(met, "c", "left").withColumn("met", F.coalesce("met", F.array().cast("array<struct<p:bigint,i:int>>")))
    part = F.pmod(F.xxhash64("c"), F.lit(parts)).alias("part")
    block = F.pmod(F.xxhash64("c", F.lit(1)), F.ceil(F.col("all") / F.lit(BLOCK * parts))).alias("block")
    blocks = members.groupBy("t", part, block).agg(F.collect_list(F.struct("c", "g", "s", "n", "k", "l", "at", "met")).alias("members")).select("t", "part", "members")
    seekers = members.filter("g <> top").select("t", "c", "g", "s", "n", "k", "l", "at", "met")
    larger = "(x.s > s or x.s = s and x.g > g)"
    fits = seekers.join(blocks, "t").select("c", "l", "part", F.expr(f"filter(members, x -> {larger} and {POSSIBLE})").alias("found")).filter("size(found) > 0")
    enough = fits.select("c", "l", "part", F.col("found.c").alias("b"), F.col("found.l").alias("lb")).groupBy("c", "part").applyInArrow(multi_match, "a long, b array<long>")
    rest_pairs = staged(verified(enough.select("a", F.explode("b").alias("b")), sets), "rest-pairs")
    return staged(components(seen.union(rest_pairs).filter("linked")), "class-labels")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id reachable by links."""
    all_docs = shared_sets(docs)
    live = all_docs.filter("tokens is not null")
    key = ["d1", "d2", "n"]
    sets = staged(live.groupBy(*key).agg(F.first("tokens").alias("tokens"), F.first("l").alias("l"), F.first("prefix").alias("prefix"), F.min("doc_id").alias("lowest")).withColumn("c", F.xxhash64("d1", "d2")).withColumn("k", F.size("tokens")), "classes")
    label = link_classes(sets.select("c", "n", "k", "l", "prefix", "tokens"))
    named = sets.select(*key, "lowest", "c").join(label.select(F.col("id").alias("c"), "label"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    lowest = named.groupBy("label").agg(F.min("lowest").alias("component_id"))
    class_of = named.select(*key, "label").join(lowest, "label").drop("label")
    linked = live.select("doc_id", *key).join(class_of, key).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = all_docs.filter("tokens is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def op10(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
u AS (SELECT doc_id, len(g) AS n, hash(unnest(g)) AS g FROM s),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM k WHERE 100 * k >= 75 * (na + nb - k)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS label FROM s UNION SELECT t.b, r.label FROM r JOIN t ON t.a = r.id WHERE r.label < t.b)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT id, min(label) AS component_id FROM r GROUP BY id) m ON m.id = s.doc_id
"""

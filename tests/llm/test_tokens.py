"""Token alignment, BPE and conversation repair against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import align, bpe, repair

LONG = " ".join(f"w{i}" for i in range(9000))
TEXTS = [
    "The cat sat on the mat. The cat's hat!", "The cat sat", "", None, LONG, "Ünïcode ſtraße wörter 你好 世界 🙂🙂", "a<|endoftext|>b </s> <0x41>", "has ▁ mark", "   lead and trail  \n\n x\t\ty", "====" * 40 + "12345" * 30,
    "The cat sat", "\x00\x1f ctrl", "don't DON'T it's", "x" * 3000, "͸ unassigned \U0001fae9", " ",
]
DOCS = "doc_id long, text string, ids string, n long, block string, pair string"


def documents(spark):
    rows = [(k if k != 11 else None, t, "x", 1, "y", "z") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0]], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def odd_texts(n, seed):
    r = np.random.default_rng(seed)
    odd = [*map(chr, [*range(0x250), 0x2014, 0x300, 0x3A3, 0x130, 0x4E00, 0x1F600, 0x200B, 0x2028, 0x660, 0xFB01, 0x558, 0x88F, 0xA0, 0x3000, 0x16D40])]
    odd += [" "] * 90 + ["'s", "'RE", "<|", "<|endoftext|>", "\n\n", "   ", "aaaa", "ing", "1234"]
    few = list("aeinrst  oh")
    return ["".join(some[k] for k in r.integers(0, len(some), r.integers(1, 60))) for i in range(n) for some in (odd, few)]


# --- BPE


@pytest.mark.parametrize("specials", [True, False])
def test_encoder_equals_library(library, specials, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 3000)
    library.encode_special_tokens = not specials
    encoder = bpe.Encoder(bpe.default_vocabulary(), specials)
    texts = [t or "" for t in TEXTS] + odd_texts(2000, 3)
    want = [np.array(e.ids, "<i4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    library.encode_special_tokens = False
    assert [x for k in range(0, len(texts), 300) for x in encoder.encode(texts[k : k + 300])] == want
    assert 0 < encoder.merged_words < encoder.new_words


def test_merging_equals_library_and_speculation(library):
    v, r = bpe.Vocabulary(bpe.default_vocabulary()), np.random.default_rng(1)
    assert v.sound
    words = ["".join(chr(c) for c in r.choice([97, 98, 101, 104, 105, 110, 32, 116, 195, 169], r.integers(1, 150))) for _ in range(400)]
    got = [np.frombuffer(x, "<i4").tolist() for x in v.merged(words)]
    assert got == [v.merged_by_queue([v.id_of[c] for c in w]) for w in words]
    letters = bpe.byte_letters()
    assert got == [[t.id for t in library.model.tokenize(w.translate(letters))] for w in words]


def test_pairs_side_by_side(library):
    v, r = bpe.Vocabulary(bpe.default_vocabulary()), np.random.default_rng(2)
    whole = np.array(sorted(v.id_of.values()))
    a, b = whole[r.integers(0, len(whole), 4000)], whole[r.integers(0, 3000, 4000)]
    letters = bpe.byte_letters()
    want = [[t.id for t in library.model.tokenize((v.bytes_of[x] + v.bytes_of[y]).decode("latin-1").translate(letters))] == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert v.side_by_side(a, b).tolist() == want and len(set(want)) == 2


def test_unsound_vocabulary_is_merged(tmp_path, library):
    import json

    from tokenizers import Tokenizer

    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        content = json.load(f)
    # a merge before those of its parts: what greedy cuts verify no longer holds
    content["model"]["merges"] = content["model"]["merges"][:2000][::-1]
    kept = {t for m in content["model"]["merges"] for t in ["".join(m if isinstance(m, list) else m.split(" "))]}
    content["model"]["vocab"] = {t: i for t, i in content["model"]["vocab"].items() if i < 256 or t in kept}
    content["added_tokens"] = []
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(content), encoding="utf-8")
    encoder = bpe.Encoder(str(path))
    assert not encoder.vocabulary.sound
    texts = odd_texts(200, 4)
    assert encoder.encode(texts) == [np.array(e.ids, "<i4").tobytes() for e in Tokenizer.from_file(str(path)).encode_batch(texts, add_special_tokens=False)]
    assert encoder.merged_words == encoder.new_words


def test_decoding_any_ids(library):
    decoder, r = bpe.Decoder(bpe.default_vocabulary()), np.random.default_rng(5)
    decode = lambda ids: decoder.decode(pa.array([[], ids, None], pa.list_(pa.int32())))[1]
    for _ in range(500):
        ids = r.integers(0, 50257 if r.random() < 0.5 else 256, r.integers(0, 30)).tolist()
        assert decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert decode([10**6, 1]) == library.decode([1])


def test_bpe_of_tables(spark, library):
    docs = documents(spark)
    rows = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((str(r.doc_id), r.text, r.ids) for r in rows) == sorted((str(r.doc_id), r.text or "", library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    assert bpe.encode(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [None, 65, -3])], "doc_id long, ids array<int>")
    assert [r.text for r in bpe.decode(odd).orderBy("doc_id").collect()] == ["", "b"]


# --- alignment


def brute_alignment(rows, library):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=align.default_pieces())
    byte_of = {letter: b for b, letter in bpe.byte_letters().items()}
    library.encode_special_tokens = True
    found = []
    for doc_id, text in rows:
        want = (" " + (text or "")).encode()
        a = [] if not text else library.encode(" " + text, add_special_tokens=False).ids
        b = [] if not text else sp.encode(text)
        a_bytes = [bytes(byte_of[c] for c in library.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if len(p := sp.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            found.append((doc_id, [], [], []))
            continue
        ranges = []
        for some in (a_bytes, b_bytes):
            at, out = 0, []
            for x in some:
                out.append((at, at + len(x)))
                at += len(x)
            ranges.append(out)
        cuts = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups = [([a[k] for k, (s, e) in enumerate(ranges[0]) if s >= lo and e <= hi], [b[k] for k, (s, e) in enumerate(ranges[1]) if s >= lo and e <= hi]) for lo, hi in zip([0, *cuts], cuts)] if len(cuts) < 500 else fast(a, b, ranges, cuts)
        found.append((doc_id, a, b, groups))
    library.encode_special_tokens = False
    documents = Counter(p for _, _, _, groups in found for p in {(x, y) for g, h in groups for x in g for y in h})
    most = defaultdict(int)
    for (x, _), n in documents.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, a, b, groups in found:
        links = [(x, y) for g, h in groups for x in g for y in h]
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(documents[p] == most[p[0]] for p in links), sum(documents[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


def fast(a, b, ranges, cuts):
    out, i, j = [], 0, 0
    for cut in cuts:
        g, h = [], []
        while i < len(a) and ranges[0][i][1] <= cut:
            g.append(a[i])
            i += 1
        while j < len(b) and ranges[1][j][1] <= cut:
            h.append(b[j])
            j += 1
        out.append((g, h))
    return out


@pytest.mark.parametrize(("block", "listed"), [(8_000_000, 1_000_000), (200, 3)])
def test_alignment_equals_brute_force(spark, library, monkeypatch, block, listed):
    monkeypatch.setattr(align, "BLOCK_BYTES", block)
    monkeypatch.setattr(align, "LISTED", listed)
    monkeypatch.setattr(align.bpe, "BLOCK", 1000)
    docs = documents(spark)
    monkeypatch.setattr("weftline.llm.packing.BATCH_BYTES", 100 if block == 200 else 2_000_000)
    got = sorted((tuple(r) for r in align.scored(align.staged(align.linked(docs), "t")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)
    assert got == brute_alignment([(r.doc_id, r.text) for r in docs.collect()], library)
    assert align.scored(align.staged(align.linked(docs.limit(0)), "t")).count() == 0


def test_alignment_lists(spark):
    rows = align.align(documents(spark)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert sum(r.a_sizes) == len(r.a_ids) and sum(r.b_sizes) == len(r.b_ids) and len(r.a_sizes) == len(r.b_sizes)
        assert all(n > 0 for n in r.a_sizes + r.b_sizes)


# --- repair


def brute_repair(symbols):
    """Every way, a row at a time, with up to three insertions in a gap."""

    @lru_cache(None)
    def best(i, state, inserted):
        ways = [(0, "")] if i == len(symbols) and state in repair.ENDS else []
        offer = lambda cost, letter, rest: ways.append((cost + rest[0], letter + rest[1]))
        for r in "ua" if inserted < 3 else "":
            if state in repair.STEPS[r]:
                offer(2, "I", best(i, repair.STEPS[r][state], inserted + 1))
        if i < len(symbols):
            role, fault = repair.ROLES[symbols[i] // 4], symbols[i] % 4
            offer(3, "D", best(i + 1, state, 0))
            if fault < 2:
                if state in repair.STEPS.get(role, ()):
                    offer(fault, "K", best(i + 1, repair.STEPS[role][state], 0))
                for r in "ua":
                    if state in repair.STEPS[r]:
                        offer(2 + fault, "R", best(i + 1, repair.STEPS[r][state], 0))
        return min(ways, default=(10**9, ""))

    return best(0, repair.START, 0)


def test_program_equals_brute_force():
    repairs, r = repair.Repairs(), random.Random(7)
    for _ in range(6000):
        some, symbols = r.sample(range(16), r.randint(1, 5)), []
        while len(symbols) < 12:
            symbols += [r.choice(some)] * r.randint(1, 5)
        symbols = bytes(symbols[: r.randint(0, 12)])
        assert repairs.repair(symbols) == brute_repair(symbols)


def test_long_runs_take_few_products(monkeypatch):
    made, plain = [], repair.product
    monkeypatch.setattr(repair, "product", lambda a, b: made.append(1) or plain(a, b))
    cost, audit = repair.Repairs().repair(bytes([4]) * 200_000)
    assert (cost, audit) == (200_000, "KR" * 100_000) and len(made) < 40


def conversations(spark):
    r, rows = random.Random(3), []
    texts = ["Well.", "Well. ", "no end", "", None, " \t\n", "a.b!c?", "Why?\n", "é…", "x" * 5000 + "."]
    for conv in [*range(150), None, -5]:
        for turn in range(r.randint(1, 9)):
            rows.append((conv, r.choice([turn, turn, turn, turn + 3, None]), r.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "User"]), r.choice(texts), turn, "x"))
    rows += [(999, None, "user", "no end", 0, "x")] * 40 + [(1000, k, "user" if k % 2 else "assistant", f"t{k % 50}.", 0, "x") for k in range(300)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault long, audit string")


def plain_repairs(rows):
    """All of it in plain Python."""
    whole = defaultdict(list)
    sp = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        own, kind = whole[conv], zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, own in whole.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.md5(x[2].encode()).hexdigest()))
        seen, symbols, faults = set(), [], Counter()
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = repair.BLANK if not bare else repair.DUPLICATE if (role, text) in seen else repair.CUT if bare[-1] not in ".!?" else repair.SOUND
            seen.add((role, text))
            faults[fault] += 1
            symbols.append(4 * max(0, "sua".find(role[:1])) + fault if role[:1] and role[0] in "sua" else 12 + fault)
        cost, audit = brute_repair(bytes(symbols)) if len(symbols) < 30 else repair.Repairs().repair(bytes(symbols))
        lines, k, odd = [], 0, 0
        for letter in audit:
            if letter != "I":
                _, role, text = own[k]
                k += 1
            if letter == "D":
                continue
            made = ("user", "assistant")[odd % 2]
            lines.append(f"{role}:{text}" if letter == "K" else f"{made}:{'' if letter == 'I' else text}")
            odd += not (letter == "K" and role[0] == "s")
        turns = {t for t, _, _ in own if t is not None}
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults[f] for f in (repair.BLANK, repair.DUPLICATE, repair.CUT)), sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def test_repair_equals_plain_version_and_sql(spark, tmp_path):
    given = conversations(spark)
    given.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in repair.op12(spark, str(tmp_path)).collect()), key=str)
    assert got == plain_repairs([tuple(r)[:4] for r in given.collect()])
    assert any(r[1] for r in got) and any("I" in r[7] for r in got) and any("R" in r[7] for r in got)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(repair.OP12_SQL)
    names = [d[0] for d in found.description]
    assert sorted((tuple(dict(zip(names, r, strict=True))[c] for c in COLUMNS) for r in found.fetchall()), key=str) == got


def test_repaired_rows_are_in_order(spark):
    rows = repair.damaged(conversations(spark))
    plans = repair.staged(repair.plan_repairs(rows), "t")
    lines = defaultdict(list)
    for r in repair.repaired(rows, plans).collect():
        lines[r.conv_id].append(r.role[0])
    import re

    assert all(re.fullmatch(r"(s?(ua)+)?", "".join(x)) for x in lines.values()) and len(lines) > 50
    empty = conversations(spark).limit(0)
    assert repair.plan_repairs(repair.damaged(empty)).count() == 0
    dropped = spark.createDataFrame([(k, 0, "user", "Hi.") for k in range(60)], "conv_id long, turn long, role string, text string")
    assert repair.plan_repairs(repair.damaged(dropped)).filter("audit = '' and cost = 0").count() == sum(zlib.crc32(f"{k}:0".encode()) % 20 == 0 for k in range(60))
    assert repair.damaged(dropped).filter(F.col("dropped")).count() > 0

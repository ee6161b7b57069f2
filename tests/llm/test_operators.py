"""Each operator on small, odd tables, against brute force where there is one."""

import base64
import hashlib
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests_llm_brute import brute_components, brute_targets
from weftline.llm import digest, html_text, licenses, media, mixing, ngram_join, packing, quality, urls, warc
from weftline.llm.common import fresh_dir

LONG = " ".join(f"w{i}" for i in range(9000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, rate double, label string"


def documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing columns."""
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd ee ff gg hh ii jj kk ll mm nn"
    rows = [
        (1, near, "en", "s1"), (2, near + " oo", "en", "s1"), (3, near, "en", None), (4, "", "en", "s2"), (5, None, None, "s2"), (6, LONG, "en", "s3"), (7, "one two", "en", "s3"), (8, "One TWO", "en", "s1"),
        (9, "Ünïcode ſtraße wörter 你好 世界", "de", "S1"), (9, "Ünïcode ſtraße wörter 你好 世界", "de", "S1"), (None, "no id here but words enough", "en", "s2"), (10, "   \t\n ", "en", "s4"), (11, near.replace("t", "T"), "en", "s1"), (12, "x " * 400, "en", "s3"),
    ]
    return spark.createDataFrame([(i, t, l, s, len(t or ""), 5, 0.5, "x") for i, t, l, s in rows], DOCS)  # noqa: E741


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- packing


def test_packing_places_every_piece(spark):
    from tokenizers import Tokenizer

    docs = documents(spark)
    got = rows(packing.pack_documents(docs))
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(bins) == -(-total // 2048)
    t = Tokenizer.from_file(packing.default_tokenizer())
    ids = np.array([*t.encode(LONG, add_special_tokens=False).ids, 0], "<u4").tobytes()
    own = sorted((r for r in got if r["doc_id"] == 6), key=lambda r: r["piece"])
    assert [r["start"] for r in own] == list(range(0, len(ids) // 4, 2048))
    assert [r["ids_crc32"] for r in own] == [zlib.crc32(ids[k : k + 8192]) for k in range(0, len(ids), 8192)]
    assert sum(r["doc_id"] == 9 for r in got) == 2
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_and_bound(seed):
    r = np.random.default_rng(seed)
    lengths = np.sort(r.integers(1, 2049 if seed % 2 else 1200, 3000))[::-1]
    where, offset, fills = packing.best_fit(lengths)
    assert np.array_equal(np.bincount(where, lengths), fills) and fills.max() <= 2048
    bound = packing.lower_bound(np.bincount(lengths, minlength=2049))
    assert bound <= len(fills) <= 1.1 * bound + 1
    # brute force: the fullest bin with room, first of equals by any order, gives the same number of bins
    open_bins = []
    for n in lengths.tolist():
        fit = [b for b in open_bins if b[0] + n <= 2048]
        if fit:
            max(fit)[0] += n
        else:
            open_bins.append([n])
    assert len(open_bins) == len(fills)


def test_lower_bound_is_a_bound():
    bound = lambda lengths: packing.lower_bound(np.bincount(np.array(lengths, int), minlength=2049))
    assert bound([1025] * 10) == 10
    assert bound([683, 683, 683]) == 2
    assert bound([]) == 0


@pytest.mark.parametrize(("low", "spread"), [(300, 900), (690, 660), (5, 60)])
def test_pools_merge_gaps_and_stay_small(spark, monkeypatch, low, spread):
    frames = []
    plain = packing.staged
    monkeypatch.setattr(packing, "staged", lambda df, name: frames.append(plain(df, name)) or frames[-1])
    df = spark.range(4000).selectExpr("id as doc_id", "0 as piece", "0L as start", f"{low} + pmod(xxhash64(id), {spread}) as length", "id as ids_crc32")
    got = packing.pack(df, part_pieces=100)
    bins = got.groupBy("sequence_id").agg({"length": "sum"}).collect()
    lengths = np.array([r[0] for r in df.select("length").collect()])
    assert max(r[1] for r in bins) <= 2048 and got.count() == got.select("doc_id").distinct().count() == 4000
    first = frames[1].select("sequence_id").distinct().count()
    assert len(bins) <= first and len(bins) <= 1.06 * packing.lower_bound(np.bincount(lengths, minlength=2049)) + 1
    assert all(f.groupBy("part").count().agg({"count": "max"}).first()[0] < 160 for f in frames[1:])


def test_encoder_equals_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["", "a<|endoftext|>b", "x\x1cy", "İstanbul ΣΑΣ don't it's", "é\u00a0a\u2003b", " \u0338a", "5€ 12345 ## hello,world", "  ", "ÿ\u0100 “odd” words – and plain's ones\n\n²½", LONG]
    odd = [chr(c) for c in [*range(0x200), *range(0x200), 0x2014, 0x201C, 0x300, 0x3A3, 0x130, 0x4E00, 0x1F600, 0x200B, 0x2028, 0x660, 0xFB01, 0x1E9E]] + [" "] * 90 + ["'s", "'RE", "<|", "<|endoftext|>"]
    r = np.random.default_rng(5)
    texts += ["".join(odd[k] for k in r.integers(0, len(odd), r.integers(1, 40))) for _ in range(3000)]
    for remembered in (250_000, 5):
        monkeypatch.setattr(packing, "REMEMBERED", remembered)
        assert packing.Encoder(packing.default_tokenizer()).encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def test_slices_are_whole_and_bounded(monkeypatch):
    monkeypatch.setattr(packing, "BATCH_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "text": ["abc", None, "x" * 50, "defgh", "", "ij", "klmno"]})
    parts = [p.column(0).to_pylist() for p in packing.slices([batch])]
    assert parts == [[0, 1], [2], [3, 4, 5], [6]]
    assert list(packing.slices([batch.slice(0, 0)])) == []


# --- HTML

PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="no-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">menu</a></ul></nav><div class="layout with-sidebar"><div class="cookie-notice"><p>We use cookies</div>
<main><article><h1>Title &amp; more</h1><p>One<b>two</b>
 three<br>four <p>five &lt;6&nbsp;7<script>var x="</p>"</script><div class="ad">Buy</div><!-- no --><section class="comments"><article class="comment"><p>nice</p></article></section></article></main>
<aside>side</aside><form>sign <input></form></div><div id="comments"><p>A long comment text, longer than the article, to draw the chooser away from it. Really long.</p></div><footer>&copy; foot</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("plain <b>x</b>\n y", "plain x y"), (PAGE, "Title & more Onetwo three four five <6 7"), ("<p>some words stand here<table><tr><td>cell one<td>cell two</table><div><a href=x>links</a><a href=y>only</a><a href=z>here</a></div>", "some words stand here cell one cell two"),
        ("<body><div class=menu><a href=x>a</a></div><div id=content><h2>T</h2><p>long text one two three four.<p>more long text here.<ul><li>item one<li>item two</ul></div><div class=footer>x</div>", "T long text one two three four. more long text here. item one item two"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


SAID = "lorem ipsum dolor sit amet, a paragraph of the text that goes on."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><form id=f><div><input type=hidden><h1>Head</h1>{5}</div><label>name</label><input></form><div class=footer>foot</div>", "Head {5}"), ("<body><form><p>Please sign in here</p><input></form><div id=c>{4}</div>", "{4}"),
        ("<main><h1>H</h1>{2}<section id=discussion><h2>Discussion</h2>{2}</section><div class='notice-period'>Two weeks {1}</div><div class='cookie-notice'>cookies!</div></main>", "H {2} Discussion {2} Two weeks {1}"),
        ("<body><article><h2>A</h2>{3}</article><article><h2>B</h2>{2}</article><article><h2>C</h2>{4}</article><article class=card><a href=x>more</a></article>", "A {3} B {2} C {4}"),
        ("<main>{3}<div class=related><a href=x>one link text here</a> <a href=y>another link</a></div></main>", "{3}"), ("<article>{3}<section class=comments><div class=comment>{4}</div></section></article>", "{3}"),
    ],
)
def test_density_decides_inside_articles(page, text):
    marked = re.sub(r"\{(\d)\}", lambda m: f"<p>{SAID}</p>" * int(m[1]), page)
    assert html_text.main_text(marked) == re.sub(r"\{(\d)\}", lambda m: " ".join([SAID] * int(m[1])), text)


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 1_700_000, '<a "' * 800_000 + ">", "<a '\"" * 300_001 + ">", "<b>" * 6000 + "</i>" * 6000, "<i><table><td>" + "<b>" * 10_000 + "</i>" * 10_000, "<b>" * 8000 + "<h1></h1>" * 8000, "<!" * 2_500_000, "<![CDATA[" * 500_000, "<div class=side>" * 3000 + "<article>" * 3000,
        "<ul>" + "<li><b>" * 10_000, "<div>" * 20_000 + "x", "word " * 1_000_000,
    ],
)
def test_long_odd_pages_take_linear_time(page):
    start = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - start < 3


def test_extract_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = rows(html_text.extract(pages))
    assert [r["n_chars"] for r in got] == [len(r["text"]) for r in got] and got[2] == {"page_id": None, "url": None, "text": "", "n_chars": 0}
    assert html_text.extract(pages.limit(0)).count() == 0


# --- licences


def brute_scan(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    hits = [(i, v) for k, v in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(k.split())] == k.split()]
    at = [i for i, _ in hits]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({v for _, v in hits}))


def test_license_scan(spark):
    texts = ["MIT license, the mit\nLICENSE; mit license", "GNU General-Public License", "cc  by cc by é-cc by", "éapache license apachelicense", "commit license", None, "", LONG + " mit license", "x\nSPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 here\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(licenses.scan_licenses(docs))}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_scan(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[8]["labels"] == "apache-2.0,classpath-exception-2.0,gpl-2.0,mit"
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_expressions():
    assert licenses.evaluate("MIT OR GPL-2.0") == ({"mit", "gpl-2.0"}, 1.0)
    assert licenses.evaluate("MIT AND GPL-2.0")[1] == 0.4
    assert licenses.evaluate("MIT OR GPL-2.0 AND ISC")[1] == 1.0
    assert licenses.evaluate("(MIT OR GPL-2.0) AND AGPL")[1] == 0.3
    assert licenses.postfix("a or b and c") == ["a", "b", "c", "and", "or"]
    for bad in ("", "AND MIT", "(MIT", "MIT OR", "()"):
        assert licenses.evaluate(bad) is None


def test_score_is_the_strictest_of_tags_and_notices():
    scan = licenses.scanner(licenses.NOTICES, licenses.BASE)
    assert scan("SPDX-License-Identifier: MIT\nAll rights reserved.")[5:] == ("all-rights-reserved,mit", 0.0)
    assert scan("SPDX-License-Identifier: MIT OR GPL-3.0-only\n")[5:] == ("gpl-3.0,mit", 1.0)
    assert scan("The tag SPDX-License-Identifier: the expression comes here")[5:] == ("", 0.0)
    assert scan("License-Expression: LicenseRef-own AND CC-BY-NC-4.0.")[5:] == ("cc-by,cc-by-nc-4.0,licenseref-own", 0.2)


def test_license_ids_of_public_families():
    scan = licenses.scanner(licenses.NOTICES, licenses.BASE)
    tag = lambda e: scan("SPDX-License-Identifier: " + e)[5:]
    assert tag("GPL-2.0 WITH Linux-syscall-note") == ("gpl-2.0,linux-syscall-note", 0.5)
    assert tag("X11 OR MIT") == ("mit,x11", 1.0) and tag("NCSA") == ("ncsa", 0.5) and tag("JSON") == ("json", 0.5)
    assert tag("covid-19 text") == ("", 0.0) and tag("c") == ("", 0.0)
    # An unknown operand leaves the value to the other.
    assert tag("(house-rules-7 AND MIT) OR covid-19") == ("mit", 1.0) and tag("nothing OR nowhere") == ("", 0.0) and tag("nothing WITH x") == ("", 0.0)
    assert scan("under CC BY-NC-ND 4.0")[4:] == ("cc-by", "cc-by,cc-by-nc,cc-by-nc-nd", 0.2)
    assert scan("Creative Commons Attribution-NonCommercial")[5:] == ("cc-by,cc-by-nc", 0.2)
    assert scan("Attribution-ShareAlike 4.0")[5:] == ("cc-by-sa", 0.6)


def test_licenses_leave_other_columns_out(spark):
    got = licenses.scan_licenses(spark.createDataFrame([(1, "mit license", "x", 7.0, "y")], "doc_id long, text string, labels string, score double, n_words string"))
    assert [tuple(r) for r in got.collect()] == [(1, 2, 1, 0, 0, "mit", "mit", 1.0)]


# --- media


def test_store_and_read_back(spark):
    docs = documents(spark)
    got = rows(media.read_back(media.store(docs)))
    texts = [r["text"] for r in rows(docs)]
    for r, t in zip(got, texts, strict=True):
        raw = (t or "").encode()
        padded = raw + b"\xff" * ((-len(raw) % 576) or (0 if raw else 576))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert r["feature"].startswith("audio/wav;") and r["media_bytes"] == len(padded) + 44
    assert media.read_back(media.store(docs.limit(0))).count() == 0


def test_sniffing_carves_and_corrects(spark):
    import gzip
    import struct

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    items = [(1, png, "image/jpeg"), (2, b"junk" + gif + b"tail" + png[:-3], "text/plain"), (3, media.to_wave(b"ab" + png), None), (4, None, None), (5, b"", "x"), (6, gzip.compress(b"hello"), "application/gzip"), (7, b"RIFF\xff\xff\xff\xffWAVE", None)]
    got = {r["k"]: r for r in rows(media.sniff(spark.createDataFrame(items, "k long, media binary, declared string"), key="k"))}
    assert (got[1]["detected"], got[1]["corrected"]) == ("image/png", True)
    assert [tuple(s) for s in got[2]["spans"]] == [("image/gif", 4, len(gif))] and got[2]["detected"] == "text/plain"
    assert got[3]["detected"] == "audio/wav" and [tuple(s) for s in got[3]["spans"]] == [("image/png", 46, len(png))]
    assert got[4]["detected"] is None and got[6]["corrected"] is False and got[7]["detected"] is None


def ogg_page(body):
    head = b"OggS\0\x02" + bytes(8) + b"abcd" + bytes(4)
    rest = bytes([1, len(body)]) + body
    crc = 0
    for byte in head + bytes(4) + rest:  # bit by bit, as the format says
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
    return head + crc.to_bytes(4, "little") + rest


def box(kind, body):
    return (8 + len(body)).to_bytes(4, "big") + kind + body


def tiff_file(order):
    n = lambda x, k: x.to_bytes(k, "little" if order == b"II" else "big")
    entry = lambda tag, value: n(tag, 2) + n(4, 2) + n(1, 4) + n(value, 4)
    return order + n(42, 2) + n(12, 4) + b"data" + n(2, 2) + entry(273, 8) + entry(279, 4) + n(0, 4)


MEDIA = {
    "audio/ogg": ogg_page(b"hello") + ogg_page(b"again"), "video/mp4": box(b"ftyp", b"isom") + box(b"moov", b"x" * 9) + box(b"mdat", b"y" * 30), "audio/mpeg": b"ID3\4\0\0\0\0\0\x05tags!" + (b"\xff\xfb\x90\0" + b"\0" * 413) * 4,
    "image/tiff": tiff_file(b"II"), "application/pdf": b"%PDF-1.4\nstuff\nstartxref\n9\n%%EOF", "image/jpeg": b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x05abc\xff\xda\0\2data\xff\0more\xff\xd9",
}


@pytest.mark.parametrize("kind", MEDIA)
def test_formats_are_found_and_cut_ones_are_not(kind):
    data, search = MEDIA[kind], media.magic()
    assert (kind, 4, len(data)) in media.spans(b"junk" + data + b"tail", search)
    assert not [s for s in media.spans(data[:-1] if kind != "audio/ogg" else data[:30], search) if s[0] == kind and s[2] >= len(data) - 1]


def test_flac_checks_a_frame_header():
    frame = b"\xff\xf8\x69\x18\x00\x0f"
    data = b"fLaC\x80\0\0\x22" + bytes(34) + frame + bytes([media.crc8(frame)]) + bytes(20)
    assert media.crc8(b"123456789") == 0xF4
    assert media.spans(data, media.magic()) == [("audio/flac", 0, len(data))]
    assert media.spans(data.replace(b"\x69\x18", b"\x69\x19"), media.magic()) == []
    assert media.spans(tiff_file(b"MM"), media.magic()) == [("image/tiff", 0, 42)]


def test_false_starts_take_linear_time():
    many = [b"%PDF-" * 80_000, b"PK\3\4" * 80_000, b"\xff\xd8\xff\xda" * 80_000, b"\x1f\x8b\x08" * 80_000, MEDIA["audio/mpeg"][15:432] * 3000, b"ID3" * 80_000, b"ftyp" * 80_000, MEDIA["audio/ogg"] * 3000]
    for data in many:
        start = time.perf_counter()
        media.spans(data, media.magic())
        assert time.perf_counter() - start < 3


def test_media_of_long_texts_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "é" * 3_000_000, b"x", "m"), (2, None, b"x", "m")], "doc_id long, text string, media binary, declared string")
    got = {r["doc_id"]: r for r in rows(media.read_back(media.store(docs)))}
    assert got[1]["n_bytes"] == 6_000_000 and got[1]["payload_bytes"] == 6_000_192 and got[2]["payload_bytes"] == 576
    assert media.sniff(docs.limit(0)).count() == 0 and media.sniff(docs).columns == ["doc_id", "detected", "corrected", "media_bytes", "spans"]


# --- mixing


def test_mixing(spark):
    docs = documents(spark)
    got = rows(mixing.mix(docs).select("doc_id", "text", "source", "size", "source_size", "target", "copies", "label"))
    sizes = defaultdict(int)
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += r["size"]
    want = brute_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 3
    assert got == rows(mixing.mix(docs.repartition(3)).select(*got[0])) or sorted(map(str, got)) == sorted(map(str, rows(mixing.mix(docs.repartition(3)).select(*got[0]))))
    assert mixing.emit(docs).columns == docs.columns and mixing.emit(docs).count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_keeps_columns_of_any_name(spark):
    rows = [(k, "a b c", "s" if k % 2 else None, 77, 88.0, 5, 9, "o", "d") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, rate double, copies long, draw long, of string, doc string")
    out = mixing.emit(docs)
    assert out.columns == docs.columns and {r[3:] for r in map(tuple, out.collect())} == {(77, 88.0, 5, 9, "o", "d")}
    mixed = mixing.mix(docs)
    assert mixed.columns == ["doc_id", "text", "source", "draw", "of", "doc", "size", "source_size", "target", "rate", "copies"]
    assert mixing.emit(docs.limit(0)).count() == 0


def test_mixing_of_very_many_sources(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', 1 + int(pmod(xxhash64(id), 30))) as text", "concat('s', pmod(id, 500)) as source")
    sizes = {r["source"]: r["n"] for r in docs.selectExpr("source", "size(split(trim(text), ' ')) as n").groupBy("source").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    want = brute_targets(sizes)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = {r["source"]: r["target"] for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * want[k] for k in want)


def test_mix_meets_targets(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', 1 + cast(id % 50 as int)) as text", "concat('s', id % 7 * (id % 3)) as source")
    for r in mixing.mix(docs).groupBy("source").agg({"target": "max", "source_size": "max"}).join(mixing.mix(docs).selectExpr("source as s", "size * copies as taken").groupBy("s").sum("taken"), mixing.F.col("s") == mixing.F.col("source")).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) < 0.15 * r["max(target)"]


# --- quality


def test_quality_learns_and_covers(spark):
    good = [(i, f"Plain words make number{i} a calm sentence of prose. It goes on, with commas, and ends. " * (1 + i % 4), "en", "s") for i in range(120)]
    bad = [(i, ("BUY!! NOW!! CHEAP!! " if i % 2 else "same same same same ") * (5 + i % 30), "en", "s") for i in range(120, 240)]
    docs = spark.createDataFrame([*good, *bad, (900, None, None, None), (901, "", None, None), (None, LONG, None, None)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)] + [(3, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in rows(quality.score(docs, model))}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i < 120) for i in held]) > 0.97
    assert all(0 <= v <= 1 for v in got.values()) and len(got) == 243
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id < 120").count() >= 118 and kept.filter("doc_id between 120 and 239").count() <= 2
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.train(docs, labels.limit(0)).constant == 0.5
    # A very long text, two texts of one id, and columns named like the results
    odd = spark.createDataFrame([(1, " ".join([LONG] * 20), 9.0), (5, "other words under the same id", 9.0), (5, "BUY!! " * 9, 9.0)], "doc_id long, text string, score double")
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    one, two = (quality.train(d, labels) for d in (both, both.orderBy(F.desc("text")).repartition(3)))
    assert all(np.array_equal(one.w[k], two.w[k]) for k in one.w)
    assert quality.score(odd, one).columns == ["doc_id", "score", "n_passages", "top_passage"] and quality.keep_good(odd, one).columns == odd.columns
    assert {r["doc_id"]: r["n_passages"] for r in rows(quality.score(odd, one))}[1] == 20 * 9000 // 96


# --- URLs


def brute_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(h.count("."), len(p), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


def test_url_filter(spark):
    rules = [*urls.RULES, ("allow", "deep.example.org", "/es/a/b"), ("block", "deep.example.org", "/es/a/"), ("allow", "x", "")]
    listed = ["http://EXAMPLE.org/es/1", "https://a.example.org/en/12?x#y", "http://example.org/en/2", "http://notexample.org/es/", "http://shop.com/de/x", "http://shop.com/fr", "http://shop.com/fr/", "http://com/de/", "nourl", "", None, "a://b://c/d", "http://org", "http://org/", "http://deep.example.org/es/a/bc", "http://deep.example.org/es/a/c/d", "http://x?a", "http://p.x", "http://example.org:80/es/"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(listed)] + [(None, listed[0], 1)], "page_id long, url string, host int")
    want = [brute_verdict(u, rules) for u in [*listed, listed[0]]]
    got = rows(urls.filter_urls(pages, rules))
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == want
    parsed = urls.filter_urls(pages, rules).select("page_id", "host", "path")
    joined = rows(urls.filter_by_join(parsed, spark.createDataFrame(rules, "action string, host string, path string"), "allow"))
    assert sorted(map(str, ((r["page_id"], r["rule"], r["verdict"]) for r in joined))) == sorted(map(str, ((r["page_id"], r["rule"], r["verdict"]) for r in got)))
    assert urls.filter_urls(pages.limit(0), rules).count() == 0


def test_bags_of_long_texts_are_pooled():
    bag = np.arange(1000 * 3, dtype=np.float32).reshape(1000, 3)
    small = quality.pooled(bag, 7)
    parts = [bag[k * 1000 // 7 : (k + 1) * 1000 // 7] for k in range(7)]
    assert small.dtype == np.float32 and np.allclose(small, [p.mean(0) for p in parts]) and quality.pooled(bag, 1000) is bag


def test_training_reads_no_held_out_label(spark):
    docs = spark.createDataFrame([(i, ("plain words of a text. " if i % 2 else "BUY!!! $$ now now now ") * (1 + i % 400)) for i in range(120)], "doc_id long, text string")
    label = lambda i: int(i % 2)
    held = {i for i in range(120) if zlib.crc32(str(i).encode()) % 3 == 1}
    honest, lying = (spark.createDataFrame([(i, 1 - label(i) if i in held and wrong else label(i)) for i in range(120)], "doc_id long, quality int") for wrong in (False, True))
    (bags, labels), (bags2, labels2) = (quality.training_bags(docs, x) for x in (honest, lying))
    assert len(bags) == 120 - len(held) and max(map(len, bags)) <= quality.FIT_PASSAGES
    assert np.array_equal(labels, labels2) and all(np.array_equal(a, b) for a, b in zip(bags, bags2, strict=True))
    assert quality.choose_lexical(docs, honest, (0.1, 1.0), folds=2) == quality.choose_lexical(docs, lying, (0.1, 1.0), folds=2)


# --- digest


def walked(docs):
    """Each document against its next one, all in one list."""
    hashed = docs.selectExpr("cast(doc_id as long) as doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h")
    plain = sorted(((r["doc_id"], r["h"], r["text"]) for r in rows(hashed)), key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]), reverse=True)
    want = []
    for k, (i, _, t) in enumerate(plain):
        after = plain[(k + 1) % len(plain)][2]
        other = digest.edited(t, after)
        a, b, c = digest.digest(t), digest.digest(other), digest.digest(after)
        want.append((i, len(t), hashlib.sha256(other.encode()).hexdigest(), digest.shown(a), digest.shown(b), digest.likeness(a, b), digest.likeness(a, c)))
    return sorted(map(str, want))


def test_against_next_with_heavy_and_null_ids(spark):
    said = lambda k: f"text number {k % 40} of this " * (1 + k % 3)
    for ids in ([None] * 60, [7] * 60, [None] * 30 + [7] * 60 + list(range(-5, 30)), [1, 1, 2]):
        docs = spark.createDataFrame([(i, said(k)) for k, i in enumerate(ids)], "doc_id long, text string")
        for ranges in (1, 5):
            assert sorted(map(str, (tuple(r.values()) for r in rows(digest.against_next(docs, ranges=ranges))))) == walked(docs)


def test_against_next(spark):
    docs = documents(spark)
    got = rows(digest.against_next(docs, ranges=3))
    assert sorted(map(str, (tuple(r.values()) for r in got))) == walked(docs)
    assert digest.against_next(docs.limit(0)).count() == 0
    assert rows(digest.against_next(docs.limit(1)))[0]["near_next"] == 1.0


def test_likeness_follows_edits():
    a = digest.digest(LONG)
    assert digest.likeness(a, a) == 1.0
    assert digest.likeness(a, digest.digest(LONG[: len(LONG) // 2])) > 0.9
    other = digest.digest(" ".join(f"{hashlib.md5(str(i).encode()).hexdigest()[:6]}" for i in range(9000)))
    assert digest.likeness(a, other) < 0.1
    assert digest.likeness(digest.digest(""), digest.digest(None)) == 1.0 and digest.likeness(digest.digest(""), a) == 0.0


def test_ranks_by_definition():
    data = np.frombuffer(LONG[:400].encode(), np.uint8)
    for i, r in enumerate(digest.ranks(data).tolist()):
        p = np.bincount(data[i : i + digest.WINDOW]) / digest.WINDOW
        h = -np.sum(p[p > 0] * np.log2(p[p > 0]))
        assert r == digest.RANKS[int(np.rint(h * 64))]


def test_features_of_long_texts_do_not_depend_on_parts(monkeypatch):
    whole = digest.features(LONG.encode())
    monkeypatch.setattr(digest, "PART_BYTES", 5000)
    assert np.array_equal(whole, digest.features(LONG.encode()))


# --- WARC


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "<p>x</p>", 0), (2, "http://b/", "<p>x</p>", 0), (3, None, None, 0), (4, "u", "", 0), (5, "é\r\n", LONG, 0), (5, "é\r\n", LONG, 0), (None, "n", "<p>x</p>", 0), (0, "late", LONG + "!", 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest int")
    folder = fresh_dir(spark, "warc")
    got = rows(warc.read_archives(warc.write_archives(df, folder, archive_bytes=40_000), folder))
    first = {}
    for i, _, h, _ in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, u, h, _ in pages:
        raw = (h or "").encode()
        again = i != first[h or ""]
        want.append((i, re.sub(r"[\r\n]", "", u or ""), None if again else raw, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted(map(str, (tuple(bytes(v) if isinstance(v, bytearray) else v for v in r.values()) for r in got))) == sorted(map(str, want))
    folder = fresh_dir(spark, "warc")
    assert {r["record_type"] for r in rows(warc.read_archives(warc.write_archives(df.filter("length(html) < 100"), folder, min_bytes=100), folder))} == {"response"}
    assert warc.read_archives(warc.write_archives(df.limit(0), folder), folder).count() == 0


def test_dictionary_sees_every_part_of_an_archive(monkeypatch):
    seen = []
    monkeypatch.setattr(warc.zstandard, "train_dictionary", lambda size, sample, **_: seen.append(sample) or (_ for _ in ()).throw(warc.zstandard.ZstdError("few")))
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 60_000)
    records = [bytes([k]) * n for k, n in enumerate([100_000, 10, 300_000, 50_000, 9_000])]
    warc.dictionary(records)
    size = sum(map(len, seen[0]))
    assert 40_000 < size < 80_000 and {0, 2, 3} <= {w[0] for w in seen[0]}
    warc.dictionary(records[1:2])
    assert seen[1] == records[1:2]


def test_archive_needs_no_more_than_itself():
    records = [warc.record(i, f"http://h/{i}", f"<p>text {i}</p>".encode() * 20, None) for i in range(300)]
    data = warc.archive(records)
    assert list(warc.read_archive(data)) == records and len(data) < sum(map(len, records)) / 4
    assert list(warc.read_archive(warc.archive(records[:1]))) == records[:1]


# --- n-gram join


def test_ngram_join_on_odd_rows(spark):
    docs = documents(spark)
    got = sorted(map(str, (tuple(r.values()) for r in rows(ngram_join.near_duplicates(docs)))))
    assert got == brute_components([(r["doc_id"], r["text"]) for r in rows(docs)])
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_on_edited_groups(spark, seed):
    r = np.random.default_rng(seed)
    vocabulary = [f"v{i}" for i in range(60)]
    line = " the same line in very many documents of this table".split()
    items = []
    for group in range(12):
        base = [vocabulary[k] for k in r.integers(0, 60, r.integers(4, 120))]
        for _ in range(int(r.integers(1, 25))):
            words = list(base)
            for _ in range(int(r.integers(0, 1 + len(words) // 16))):
                words[int(r.integers(0, len(words)))] = vocabulary[int(r.integers(0, 60))]
            items.append((len(items), " ".join(words + (line if r.random() < 0.4 else []))))
    got = sorted(map(str, (tuple(x.values()) for x in rows(ngram_join.near_duplicates(spark.createDataFrame(items, "doc_id long, text string"))))))
    assert got == brute_components(items)


def test_shingles_by_definition():
    texts = ["a b c d e f", "a b c d e f a b c d e", "", None, "x", "x y", "\x0bX\x1cY z", "é ü"]
    tokens, doc = ngram_join.shingles(texts, ngram_join.Powers())
    assert np.bincount(doc, minlength=len(texts)).tolist() == [2, 6, 0, 0, 1, 1, 1, 1]
    assert len(set(tokens[doc == 0]) & set(tokens[doc == 1])) == 2


def version_chain(r, name):
    """Versions of a short text, each a word or two from the last, in 1 to 299 copies."""
    words, out = [f"{name}w{k}" for k in range(int(r.integers(20, 40)))], []
    for v in range(12):
        out += [" ".join(words)] * int(r.integers(1, 300))
        for _ in range(int(r.integers(1, 3))):
            k, kind = int(r.integers(0, len(words))), r.integers(0, 3)
            words[k : k + (kind != 1)] = [[f"{name}x{v}"], [f"{name}y{v}"], []][kind]
        if r.random() < 0.5:
            words.append(f"{name}z{v}")
    return out


def test_ngram_join_counts_lists_from_both_sides(spark):
    r = np.random.default_rng(3)
    chains = [version_chain(r, f"c{k}") for k in range(25)]
    items = list(enumerate(chains[3] + chains[24]))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows(ngram_join.near_duplicates(spark.createDataFrame(items, "doc_id long, text string")))}
    first = {}
    for i, t in items:
        first.setdefault(t, i)
    assert len(got) == len(items) and all(got[i] == got[first[t]] for i, t in items)
    assert sorted(str((i, *got[i])) for i in first.values()) == brute_components([(i, t) for t, i in first.items()])


def edited_group(r, name):
    """Short texts edited from one another, each in 1 to 16 exact copies, in words of their own."""
    base, out = [f"{name}.{k}" for k in range(int(r.integers(9, 45)))], []
    texts = [base]
    for v in range(int(r.integers(2, 14))):
        words = list(texts[int(r.integers(0, len(texts)))] if r.random() < 0.5 else base)
        for _ in range(int(r.integers(0, 3))):
            k = int(r.integers(0, len(words)))
            words[k : k + int(r.integers(0, 2))] = [f"{name}.v{v}"] * int(r.integers(0, 2))
        texts.append(words)
    for words in texts:
        out += [" ".join(words)] * int(r.integers(1, 17))
    return out


def test_ngram_join_on_many_vocabularies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART_MEMBERS", 4)
    r = np.random.default_rng(11)
    items, groups = [], []
    for k in range(300):
        texts = edited_group(r, f"g{k}")
        groups.append([(len(items) + i, t) for i, t in enumerate(texts)])
        items += groups[-1]
    order = r.permutation(len(items))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows(ngram_join.near_duplicates(spark.createDataFrame([items[k] for k in order], "doc_id long, text string")))}
    assert len(got) == len(items)
    for group in groups:
        first = {}
        for i, t in group:
            first.setdefault(t, i)
        assert all(got[i] == got[first[t]] for i, t in group)
        assert sorted(str((i, *got[i])) for i in first.values()) == brute_components([(i, t) for t, i in first.items()])


def test_license_tags_in_any_case():
    scan = licenses.scanner(licenses.NOTICES, licenses.BASE)
    for tag in licenses.TAGS:
        for text in (tag, tag.upper(), tag.title(), "".join(c.upper() if k % 2 else c for k, c in enumerate(tag))):
            assert scan(f"{text} MIT\n")[5:] == ("mit", 1.0), text


@pytest.mark.parametrize("part", [b"\0\0\0\x08ftyp", b"\0\0\0\x08moov\0\0\0\x08ftyp", b"RIFF\x20\0\0\0WAVE", b"RIFF\x7f\x7f\0\0AVI ", b"RIFF\0\0\x01\0WAVEfmt ", b"\xff\xfb\x90", b"GIF89a", b"PK\x03\x04", b"%PDF-"])
def test_false_starts_take_linear_time(part):
    search = media.magic()
    for data in (media.to_wave(part * 30_000), part * 30_000):
        began = time.process_time()
        media.spans(data, search)
        assert time.process_time() - began < 4


def plain_riff(data, at):
    size, kind, place, chunks = int.from_bytes(data[at + 4 : at + 8], "little") + 8, data[at + 8 : at + 12], at + 12, set()
    if at + 12 > len(data) or kind not in (b"WAVE", b"WEBP", b"AVI ") or at + size > len(data) or size < 20:
        return None
    while place + 8 <= at + size:
        chunks.add(data[place : place + 4])
        place += 8 + int.from_bytes(data[place + 4 : place + 8], "little")
        place += (place - at) & 1
    return size if place >= at + size and place - (at + size) <= 1 and (kind != b"WAVE" or {b"fmt ", b"data"} <= chunks) else None


def plain_mp4(data, at):
    place, seen = at, set()
    while 0 <= place and place + 8 <= len(data) and (kind := data[place + 4 : place + 8]) in media.BOXES:
        size = int.from_bytes(data[place : place + 4], "big")
        size = int.from_bytes(data[place + 8 : place + 16], "big") if size == 1 and place + 16 <= len(data) else size
        size = size or len(data) - place
        if size < 8 or place + size > len(data):
            return None
        seen.add(kind)
        place += size
    return place - at if seen & {b"moov", b"meta", b"moof"} else None


def test_chains_equal_plain_walks():
    r = np.random.default_rng(11)
    box = lambda: r.integers(0, 40) % 28
    found = 0
    for _ in range(400):
        parts = []
        for _ in range(r.integers(1, 25)):
            kind = [b"ftyp", b"moov", b"mdat", b"meta", b"fmt ", b"data", b"junk"][r.integers(0, 7)]
            n = int(box())
            parts.append([(n + 8).to_bytes(4, "big") + kind + bytes(n), b"RIFF" + int(r.integers(0, 90)).to_bytes(4, "little") + [b"WAVE", b"AVI "][r.integers(0, 2)], kind + n.to_bytes(4, "little") + bytes(n)][r.integers(0, 3)])
        data = media.Bytes(b"".join(parts))
        for at in range(-4, len(data)):
            assert media.mp4(data, at) == plain_mp4(bytes(data), at)
            if at >= 0:
                length = media.riff(data, at)
                assert length == plain_riff(bytes(data), at)
                found += length is not None
    assert found > 5


def test_many_tags_in_a_line_take_linear_time():
    scan = licenses.scanner(licenses.NOTICES, licenses.BASE)
    for text in ("license-expression: mit or " * 40_000, "license-expression: mit " * 40_000, "spdx-license-identifier: " + "mit or " * 150_000):
        began = time.process_time()
        scan(text)
        assert time.process_time() - began < 4
    assert scan("license-expression: mit license-expression: bsd-3-clause\nand gpl-2.0")[5] == "bsd-3-clause,mit"


@pytest.mark.parametrize("page", ["<form>" * 60_000 + "<article>" * 60_000, "<form>" * 60_000 + "<article>x</article>" * 60_000, "<div class=ad>" * 40_000 + "<div><article>x</div>" * 40_000])
def test_articles_in_deep_pages_take_linear_time(page):
    began = time.process_time()
    html_text.parse(page)
    assert time.process_time() - began < 6


MENU = '<div class="menu"><a href=1>Home</a> <a href=2>News</a></div><div class="cookie-notice">We use cookies here.</div>'
PARAGRAPHS = [f"Long paragraph number {k} about the river and its banks, and what the town did there in spring." for k in range(5)]


@pytest.mark.parametrize("name", ["promotion-story", "legal-news", "search-results", "side-effects", "notice", "copyright"])
@pytest.mark.parametrize("tag", ["div", "section"])
@pytest.mark.parametrize("around", ["{}", '<div class="widget-wrap">{}</div>'])
def test_html_a_name_does_not_drop_what_holds_the_page(name, tag, around):
    text = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    page = f"<html><body>{MENU}{around.format(f'<{tag} class={name}>{text}</{tag}>')}</body></html>"
    assert html_text.main_text(page) == " ".join(PARAGRAPHS)


@pytest.mark.parametrize("name", ["promotion-story", "legal-news", "side-effects"])
def test_html_sections_with_a_word_of_their_own_stay(name):
    text = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    page = f'<html><body>{MENU}<div class=content>{text}<section id="{name}">{text}</section></div></body></html>'
    assert html_text.main_text(page) == " ".join(PARAGRAPHS + PARAGRAPHS)


def test_html_parts_of_the_layout_still_go():
    text = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    for part in ('<div class="legal-links">Our terms of use</div>', '<div class="ad-box">Buy this now</div>', '<div id="sidebar"><p>Also on this site</p></div>', f'<div class="comments">{text}{text}{text}</div>'):
        assert html_text.main_text(f"<html><body>{MENU}<div class=content>{text}</div>{part}</body></html>") == " ".join(PARAGRAPHS)
    assert html_text.main_text(f"<html><body>{MENU}</body></html>") == ""


def test_mix_keeps_chosen_columns(spark):
    docs = spark.createDataFrame([(k, "a b c " * (k % 5), f"s{k % 3}", k) for k in range(200)], "doc_id long, text string, source string, size long")
    names = ["doc_id", "size", "source_size", "target", "copies"]
    narrow = mixing.mix(docs, keep=["doc_id"])
    assert narrow.columns == ["doc_id", "size", "source_size", "target", "rate", "copies"]
    assert sorted(narrow.select(*names).collect()) == sorted(mixing.mix(docs).select(*names).collect())

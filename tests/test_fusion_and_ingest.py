"""Entity resolution, attribute merging, ingest and storing on small tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import fuse, models
from weftline.sources import ingest, store

T = dt.datetime(2020, 1, 1)


def people(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, email string, github_user string")


def test_bridge(spark):
    p = people(spark, [(1, "Ann Lee", "X@mail.org", None), (2, "B", None, "g"), (3, "C", "x@mail.org", "G"), (4, "D", "nobody@x.org", None), (5, "E", "nobody@x.org", None), (6, "ann lee", None, None)])
    fusion = fuse.entity_fusion(p, fuse.match_edges(fuse.candidates(p)))
    got = {r["id_other"]: (r["id_lowest"], r["comment"]) for r in fusion.collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 1}
    assert got[3][1] == "email match: x@mail.org" and got[6][1] == "name match: ann lee" and got[4][1] == "no match"


def test_fusion_does_not_depend_on_order(spark):
    rows = [(i, f"n{i}", f"u{i // 4}@mail.org", f"g{i // 9}" if i % 5 == 0 else None) for i in range(1, 80)]
    a = {tuple(r) for r in fuse.entity_fusion(people(spark, rows), fuse.match_edges(fuse.candidates(people(spark, rows)))).collect()}
    back = people(spark, rows[::-1]).repartition(5)
    assert a == {tuple(r) for r in fuse.entity_fusion(back, fuse.match_edges(fuse.candidates(back))).collect()}


def test_similar_pairs_against_all_pairs(spark):
    import random

    r = random.Random(5)
    keys = sorted({" ".join("".join(r.choice("abc") for _ in range(r.randint(2, 5))) for _ in range(r.randint(2, 14))) for _ in range(70)})
    keys += [k + " abcab" for k in keys if len(k) > 40]
    grams = {k: {f"  {w} "[i : i + 3] for w in k.split() for i in range(len(w) + 1)} for k in keys}
    for t in (0.5, 0.95):
        want = {(x, y) for x in grams for y in grams if x < y and len(grams[x] & grams[y]) / len(grams[x] | grams[y]) > t}
        got = {(p["x"], p["y"]) for p in fuse.similar_pairs(spark.createDataFrame([(k,) for k in grams], "k string"), "k", t).collect()}
        assert got == want


def test_candidates_of_similar_names_grow_with_the_names(spark):
    from weftline.functions import names

    digits = str.maketrans("0123456789", "bcdfghjklm")
    counts = []
    for n in (500, 2000):
        rows = [(f"the person customer {k * 7919:09d}".translate(digits),) for k in range(n)]
        sets = spark.createDataFrame(rows, "k string").withColumn("grams", names.trigrams(F.col("k")))
        counts.append(fuse.similar_candidates(sets, "k", 0.95).count())
    assert counts[1] <= 6 * max(counts[0], 500)


def test_long_names_that_differ_in_two_trigrams(spark):
    long = " ".join(f"w{k}ab" for k in range(40))
    keys = [long + " xy", long + " xz", long + " xy q", long, "short xy", "short xz"]
    grams = {k: {f"  {w} "[i : i + 3] for w in k.split() for i in range(len(w) + 1)} for k in keys}
    want = {(x, y) for x in keys for y in keys if x < y and len(grams[x] & grams[y]) / len(grams[x] | grams[y]) > 0.95}
    got = {(p["x"], p["y"]) for p in fuse.similar_pairs(spark.createDataFrame([(k,) for k in keys], "k string"), "k", 0.95).collect()}
    assert got == want and len(want) > 2


def test_members_of_a_group_are_listed_once(spark):
    fusion = spark.createDataFrame([(k, 1 if k <= 300 else k) for k in range(1, 400)], "id_other long, id_lowest long")
    batches = spark.createDataFrame([(k, k % 3) for k in range(1, 400)], "id long, batch_id long")
    ids = spark.createDataFrame([(k,) for k in range(1, 302)], "id long")
    got = [tuple(r) for r in fuse.group_members(ids, fusion, batches).collect()]
    assert sorted(got) == [(1 if k <= 300 else k, k, k % 3) for k in range(1, 302)]
    pairs = {tuple(r) for r in fuse.fused_of(ids, fusion, batches).collect()}
    own = {m: g for g, m, _ in got}
    assert pairs == {(k, own[k], m, b) for k in own for g, m, b in got if g == own[k]}


def test_nearest_names(spark):
    p = people(spark, [(1, "jon smythe", None, None), (2, "jon smythe", None, None), (3, "john", None, None), (4, "other person", None, None)])
    got = {r["a"]: (r["b"], r["sim"]) for r in fuse.nearest_names(fuse.candidates(p)).collect()}
    assert got == {1: (2, 1.0), 2: (1, 1.0)}


def test_later_null_overrides_and_goes(spark):
    rows = [(5, 5, {"email": '"x"'}), (5, 9, {"email": None, "n": "1"}), (6, 6, {"a": '{"b": null, "c": [1, {"d": null}]}'}), (7, 7, {"z": "null"})]
    src = spark.createDataFrame(rows, "owner long, src_id long, attrs map<string,string>")
    got = {r["owner"]: r["attrs"] for r in fuse.merge_attrs(src, nested=True).collect()}
    assert got == {5: {"n": "1"}, 6: {"a": '{"c":[1,{}]}'}, 7: {}}


def test_remap_drops_edges_without_a_group(spark):
    fusion = spark.createDataFrame([(2, 1), (3, 1), (4, 4), (5, 5)], "id_other long, id_lowest long")
    links = spark.createDataFrame([(1, 1, 2), (2, 2, 4), (3, 3, 5), (4, 2, 3)], "id long, src_id long, dst_id long")
    assert {tuple(r) for r in fuse.fused_observations(links, fusion).collect()} == {(2, 1, 4), (3, 1, 5), (4, 1, 1)}
    assert {tuple(r) for r in fuse.dangling(links, spark.createDataFrame([(1,), (2,), (3,), (5,)], "id long")).collect()} == {(2, 4)}


COMMITS = "sha string, author struct<name:string,email:string>, authored timestamp, committer struct<name:string,email:string>, committed timestamp, message string, files array<struct<path:string,insertions:int,deletions:int,lines:int>>"


def test_git(spark):
    one = ("a" * 40, ("Ann", "a@x"), T, ("Bob", "b@x"), T + dt.timedelta(days=1), "m", [("f", 1, 2, 3), ("g", 1, 0, 1)])
    entities, edges, _ = ingest.git(spark.createDataFrame([one, one], COMMITS))
    assert {r["key"] for r in entities.collect()} == {"person:Ann <a@x>", "person:Bob <b@x>", "git_commit:" + "a" * 10, "file:f", "file:g"}
    assert sorted((r["type"], r["time"].day) for r in edges.collect()) == [("committed", 2), ("created", 1), ("modified", 1), ("modified", 1)]
    e, o = ingest.numbered(entities, edges, 1, 100)
    assert sorted(r["id"] for r in e.collect()) == list(range(100, 105)) and sorted(r["id"] for r in o.collect()) == list(range(105, 109))
    assert json.loads(next(r["attrs"]["insertions"] for r in o.collect() if r["type"] == "modified")) == 1


def test_mail(spark):
    columns = "from_name string, from_email string, to_name string, to_email string, cc_name string, cc_email string, subject string, date string, raw_date_string string, message_id string, refs array<struct<ref:string>>, body_text string, flagged_abuse string, filename string"
    rows = [
        ("A", "a@x", "B", "b@x", None, None, "s\x00", "2020-01-01 00:00:00", "r", "m1", [("m0",), ("m2",)], "b", None, "f"),
        (None, "z@x", None, None, "C", "c@x", "s", "bad", "Thu, 23 May 2002 23.19.24 +0200", "m2", None, "b", None, "f"), ("A", "a@x", "B", "b@x", None, None, "s", None, None, "m3", None, "b", None, "f"),
    ]
    entities, edges, _ = ingest.mail(spark.createDataFrame(rows, columns))
    found = {r["key"]: r["attrs"] for r in entities.collect()}
    assert set(found) == {"person:A <a@x>", "person:B <b@x>", "person:C <c@x>", "message:m0", "message:m1", "message:m2"}
    assert found["message:m0"] == {} and json.loads(found["message:m1"]["subject"]) == "s<NULL>"
    assert sorted((r["type"], r["src"], r["dst"]) for r in edges.collect()) == sorted([("message_from", "person:A <a@x>", "message:m1"), ("message_to", "message:m1", "person:B <b@x>"), ("message_cc", "message:m2", "person:C <c@x>"), ("message_ref", "message:m1", "message:m0"), ("message_ref", "message:m1", "message:m2")])


def test_pull_requests(spark):
    author = "struct<name:string,email:string,login:string>"
    message = f"struct<author:{author},bodyText:string,publishedAt:timestamp>"
    schema = f"number long, bodyText string, publishedAt timestamp, author {author}, mergeCommit struct<oid:string>, commits array<struct<oid:string,message:string>>, comments array<{message}>, reviews array<struct<id:string,author:{author},bodyText:string,publishedAt:timestamp,comments:array<{message}>>>"
    ann, bob = ("Ann", "a@x", "ann"), (None, None, "bob")
    rows = [(1, "body", T, ann, ("c9",), [("c1", "m")], [(bob, "hi", T), (None, "anon", T)], [("r1", ann, "ok", T, [(bob, "re", T)])]), (2, "b", T, None, None, None, None, None)]
    entities, edges, _ = ingest.pull_requests(spark.createDataFrame(rows, schema), "repo")
    kinds = sorted(r["type"] for r in entities.collect())
    assert kinds == sorted(["person"] * 2 + ["github_pullrequest"] * 2 + ["git_commit"] * 2 + ["github_review"] + ["message"] * 3)
    assert sorted(r["type"] for r in edges.collect()) == sorted(["created", "merged_as", "attached_to", "message_to", "message_to", "message_from", "attached_to", "created", "message_to", "message_from"])


def test_proposals_and_references(spark):
    rows = [(1, "u", "Process", "Final", "t", "Ann B <a@x>; Bob", "05-Jun-2001", None, "2", None), (2, "u", "Standards Track", "Final", "t", "Ann B <a@x>", "06-Jun-2002", "1", None, "1")]
    peps = spark.createDataFrame(rows, "number long, url string, type string, status string, title string, authors string, created string, replaces string, superseded_by string, requires string")
    entities, edges, _ = ingest.proposals(peps)
    assert entities.filter("type = 'person'").count() == 2
    assert sorted((r["type"], r["src"][:5], r["dst"], r["time"].year) for r in edges.collect()) == [("created", "perso", "pep:1", 2001), ("created", "perso", "pep:1", 2001), ("created", "perso", "pep:2", 2002), ("requires", "pep:2", "pep:1", 2002), ("superseded_by", "pep:1", "pep:2", 2002)]
    items = spark.createDataFrame([(10, T, "PEP 8 and pep 8.", "see pep 008 or pep 9"), (11, T, "pep 9", None)], "id long, time timestamp, subject string, body string")
    to = spark.createDataFrame([(100, 8), (101, 9)], "id long, number long")
    assert {(r["src_id"], r["dst_id"], r["field"]) for r in ingest.link_text_refs(items, to, fields=("subject", "body")).collect()} == {(10, 100, "subject")}


def test_conflicts_are_reported(spark):
    rows = spark.createDataFrame([("k", "t", "n", {"a": '"1"'}), ("k", "t", "n", {"a": '"2"', "b": None}), ("k", "t", "n", {"b": "3"})], "key string, type string, name string, attrs map<string,string>")
    kept, conflicts = ingest.merged(rows)
    assert kept.first()["attrs"] == {"a": '"2"', "b": "3"} and [tuple(r) for r in conflicts.collect()] == [("k", "a", 2)]


def test_batches(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "id long, batch_id long")
    store.write_batch(rows(1, 2), root, "entity", "one")
    store.write_batch(rows(3), root, "entity", "two")
    store.write_batch(rows(4), root, "entity", "one")
    assert {r["id"] for r in store.load(spark, root, "entity").collect()} == {3, 4}
    batches = spark.createDataFrame([(1, "one"), (2, "two")], "id long, resource string")
    assert store.reset_resource({"e": rows(1)}, batches, "one")["e"].count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"n": 1},\n {"n": 2}]')
    (tmp_path / "b.json").write_text('{"n": 1}\n{"n": 2}\n{"n": 3}\n')
    (tmp_path / "w.txt").write_text(" Foo\n\nbar\n")
    (tmp_path / "w.csv").write_text("A,B\nx,Y\n,z\n")
    assert store.json_records(spark, str(tmp_path / "a.json"), "n int").count() == 2 and store.json_records(spark, str(tmp_path / "b.json"), "n int").count() == 3
    assert {r["term"] for r in store.word_lists(spark, str(tmp_path / "w.txt")).collect()} == {"foo", "bar"}
    assert {tuple(r) for r in store.word_lists(spark, str(tmp_path / "w.csv")).collect()} == {("A", "x"), ("B", "y"), ("B", "z")}
    spark.createDataFrame([(1,)], "from_name int").write.parquet(str(tmp_path / "m"))
    with pytest.raises(ValueError, match="columns missing"):
        store.messages(spark, str(tmp_path / "m"))


def test_ols_trials(spark):
    df = spark.createDataFrame([(i, float(i), 3.0 * i + 1) for i in range(60)], "id long, x double, y double")
    for r in models.ols_trials(df, "id", "x", "y", 5).collect():
        assert abs(r["slope"] - 3) < 1e-9 and abs(r["r2_test"] - 1) < 1e-9 and 30 < r["n_train"] < 60
    assert models.naive_baseline(spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "y double"), "y").first()["constant"] == 2.0


def test_every_rule_and_every_type(spark):
    p = people(spark, [(1, "Jon Smythe", None, None), (2, "Jon Smithe", None, None), (3, "Other Person", None, None)])
    commits = spark.createDataFrame([(10, "s"), (11, "s"), (12, "t"), (13, None), (14, None)], "id long, sha string")
    got = {r["id_other"]: r["id_lowest"] for r in fuse.entity_fusion(spark.range(1, 21), fuse.all_edges(fuse.candidates(p), commits)).collect()}
    assert got == {i: {2: 1, 11: 10}.get(i, i) for i in range(1, 21)}


def test_a_filter_of_types_reaches_the_sources(spark):
    rows = [("person:a", "person", "a", {"x": '"1"'}), ("person:b", "person", "b", {})]
    schema = "key string, type string, name string, attrs map<string,string>"
    people_ = spark.createDataFrame(rows, schema).withColumn("type", F.lit("person"))
    works = spark.range(5).selectExpr("concat('work:', id) as key", "'work' as type", "'w' as name", "map('x', cast(raise_error('read') as string)) as attrs")
    got = ingest.merged(people_.unionByName(works))[0].filter("type = 'person'").collect()
    assert {(r["key"], r["type"], r["name"], tuple(r["attrs"].items())) for r in got} == {("person:a", "person", "a", (("x", '"1"'),)), ("person:b", "person", "b", ())}

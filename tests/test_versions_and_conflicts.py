"""Versions of derived tables, conflicts of attributes, authors of either shape, proposals from texts, fusion by every rule."""

import datetime as dt
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.functions import names
from weftline.operators import fuse
from weftline.plans import fixture, fusion_queries
from weftline.sources import ingest, store

T = dt.datetime(2020, 1, 1)
DATA = "/root/testdata/sf0.001"


def test_a_failed_rebuild_leaves_the_old_version(spark, tmp_path):
    derived = store.Derived(spark, f"file://{tmp_path}/derived")
    with pytest.raises(LookupError, match="to be built"):
        derived.read("one")
    derived.publish({"one": spark.range(3), "two": spark.range(4)})
    broken = spark.range(9).select(F.when(F.col("id") == 5, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        derived.publish({"one": spark.range(30), "two": broken})
    assert (derived.read("one").count(), derived.read("two").count()) == (3, 4)
    derived.publish({"one": spark.range(5), "two": spark.range(6)})
    assert (derived.read("one").count(), derived.read("two").count()) == (5, 6)
    derived.drop_old(keep=1)
    assert len(os.listdir(tmp_path / "derived/versions")) == 1 and derived.read("one").count() == 5


def test_an_ingest_makes_derived_tables_out_of_date(spark, tmp_path):
    derived = store.Derived(spark, f"file://{tmp_path}/derived")
    derived.publish({"one": spark.range(3)})
    store.write_batch(spark.range(2), f"file://{tmp_path}/db", "entity", "a", derived)
    with pytest.raises(LookupError, match="out of date"):
        derived.read("one")
    assert derived.current() == ""
    derived.publish({"one": spark.range(7)})
    assert derived.read("one").count() == 7 and sorted(derived.pointers()) == [1, 2, 3]


def test_two_rebuilds_at_once(spark, tmp_path, monkeypatch):
    one, two = (store.Derived(spark, f"file://{tmp_path}/derived") for _ in range(2))
    one.publish({"t": spark.range(1)})
    seen = two.pointers()
    one.publish({"t": spark.range(2)})
    monkeypatch.setattr(two, "pointers", lambda: seen)
    with pytest.raises(Exception, match="(?i)exist"):
        two.publish({"t": spark.range(3)})
    assert one.read("t").count() == 2


AUTHOR = "struct<name:string,email:string,login:string>"
NESTED = "struct<name:string,email:string,user:struct<login:string>>"


def requests(spark, rows, author=AUTHOR, commit="struct<oid:string>"):
    message = f"struct<author:{author},bodyText:string,publishedAt:timestamp>"
    return spark.createDataFrame(rows, f"number long, bodyText string, publishedAt timestamp, author {author}, mergeCommit struct<oid:string>, commits array<{commit}>, comments array<{message}>, reviews array<struct<id:string,author:{author},bodyText:string,publishedAt:timestamp,comments:array<{message}>>>")


def test_conflicts_are_kept_or_raised(spark):
    row = lambda body: (1, body, T, ("Ann", None, "ann"), None, None, None, None)
    both = requests(spark, [row("a"), row("b"), row(None)])
    entities, _, conflicts = ingest.pull_requests(both, "r")
    assert [tuple(r) for r in conflicts.collect()] == [("github_pullrequest:r PR 1", "body_text", 2)]
    assert entities.filter("type = 'github_pullrequest'").first().attrs["body_text"] == '"b"'
    with pytest.raises(Exception, match="conflicting values: github_pullrequest:r PR 1 body_text"):
        ingest.pull_requests(both, "r", strict=True).entities.collect()
    once = ingest.pull_requests(requests(spark, [row("a"), row(None)]), "r", strict=True)
    assert once.entities.count() == 2 and once.conflicts.count() == 0


def test_authors_of_either_shape(spark):
    flat = requests(spark, [(1, "b", T, ("Ann", "a@x", "ann"), None, [("c1",)], [((None, None, "bob"), "hi", T), (None, "x", T)], None)])
    commit = "struct<oid:string,author:struct<name:string,email:string,date:string,user:struct<login:string>>,committer:struct<name:string,email:string,user:struct<login:string>>>"
    commits = [("c1", ("Cy", "c@x", "2019-05-06T07:08:09", ("cy",)), ("Web", None, None)), ("c2", None, None)]
    nested = requests(spark, [(1, "b", T, ("Ann", "a@x", ("ann",)), None, commits, [((None, None, ("bob",)), "hi", T), (None, "x", T)], [("r", None, "ok", T, None)])], NESTED, commit)
    persons = lambda got: {(r.key, r.attrs.get("github_user")) for r in got.entities.filter("type = 'person'").collect()}
    own = {("person:Ann <a@x> <GH ann>", '"ann"'), ("person:<GH bob>", '"bob"')}
    assert persons(ingest.pull_requests(flat, "r")) == own
    got = ingest.pull_requests(nested, "r")
    assert persons(got) == own | {("person:Cy <c@x> <GH cy>", '"cy"'), ("person:Web", "null")}
    attached = {r.src: r.time for r in got.observations.filter("type = 'attached_to' and src like 'git_commit:%'").collect()}
    assert attached == {"git_commit:c1": dt.datetime(2019, 5, 6, 7, 8, 9), "git_commit:c2": T}
    assert got.observations.filter("src like '%Cy%' or src like '%Web%'").count() == 0


def test_proposals_from_texts(spark):
    text = "PEP: 1\r\nTitle: A: b\n  and more\nStatus: Draft\nstatus line without\nStatus:  Final \nSuperseded-By: 3\n\t4\nType: Process\n \nRequires: 9\n"
    index = spark.createDataFrame([(1, "u", "t", "GvR, Doe, Nobody"), (2, "u", "t", None)], "number long, url string, title string, authors string")
    pages = spark.createDataFrame([(1, text)], "number long, text string")
    authors = spark.createDataFrame([(0, "Rossum, Guido (GvR)", "g at x.org"), (1, "Doe", "old at x"), (2, "Doe, Jo, Jr", " ")], "place long, name string, email string")
    got = {r.number: r for r in ingest.proposal_records(index, pages, authors).collect()}
    one = got[1]
    assert (one.type, one.status, one.superseded_by, one.requires, one.created, one.authors) == ("Process", "Final", "3 4", "", "", "Guido Rossum <g@x.org>; Jo Doe Jr <>")
    assert (got[2].authors, got[2].status) == ("", "")
    fields = pages.select(F.explode(ingest.header_fields(F.col("text"))).alias("f")).collect()
    assert [(r.f.name, r.f.value) for r in fields][1] == ("Title", "A: b and more")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_every_rule_links_and_equals_plain_search(spark):
    """Components by all rules, against all pairs compared in plain Python."""
    persons = fuse.candidates(fusion_queries.named_persons(spark, DATA))
    keyed = persons.select("id", "name", "email", "github_user", names.valid_email(F.col("email")).alias("ok"), names.phonetic_key(F.col("name")).alias("key"), names.trigrams(names.phonetic_key(F.col("name"))).alias("grams")).collect()
    commits = fusion_queries.hashed_commits(spark, DATA).collect()
    pairs, linked = [], defaultdict(set)
    for rule in ("email", "github_user", "name", "similar"):
        groups = defaultdict(list)
        for r in keyed:
            value = {"email": r.email if r.ok else None, "github_user": r.github_user, "name": r.name if " " in r.name and len(r.name) > 5 else None}.get(rule)
            if value:
                groups[value].append(r.id)
        found = [(a, b) for g in groups.values() for a, b in zip(g, g[1:])]
        if rule == "similar":
            grams = {r.id: set(r.grams) for r in keyed if r.key is not None}
            for r in keyed:
                if r.key is None or " " not in r.name or len(r.name) <= 5:
                    continue
                near = [(-len(grams[r.id] & g) / len(grams[r.id] | g), i) for i, g in grams.items() if i != r.id]
                best = min(near)
                if -best[0] > 0.95:
                    found.append((r.id, best[1]))
        pairs += found
        linked[rule] = {tuple(sorted(p)) for p in found}
    shas = defaultdict(list)
    for c in commits:
        shas[c.sha].append(c.id)
    pairs += [(a, b) for g in shas.values() for a, b in zip(g, g[1:])]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r.id_other: r.id_lowest for r in fusion_queries.whole_fusion(spark, DATA).collect()}
    assert got == {i: top(i) for i in got}
    part = {r.id_other: r.id_lowest for r in fusion_queries.fusion(spark, DATA).collect()}
    assert linked["similar"] - linked["name"] - linked["email"] and any(got[i] != part[i] for r in keyed for i in [r.id]) and any(got[c.id] != c.id for c in commits)


def test_edges_get_merged_attrs_with_owners_here_and_there(spark):
    obs = spark.createDataFrame([(1, 10, 20), (5, 10, 21), (6, 99, 20), (7, 20, 20), (9, 21, 10), (None, 10, 20)], "id long, src_id long, dst_id long")
    fusion = spark.createDataFrame([(10, 10), (20, 10), (21, 21)], "id_other long, id_lowest long")
    sources = spark.createDataFrame(
        [(5, 0, {"a": "1", "b": "2"}), (5, 1, {"a": "null", "c": None}), (7, 0, {}), (8, 0, {"a": "3"}), (6, 0, {"a": "4"})], "owner long, src_id long, attrs map<string,string>"
    )
    got = {tuple(r)[:3]: r.attrs for r in fuse.fused_observation_attrs(obs, sources, fusion).collect()}
    assert got == {(1, 10, 10): {}, (5, 10, 21): {"b": "2"}, (7, 10, 10): {}, (9, 21, 10): {}, (None, 10, 10): {}}
    assert [r.attrs for r in fuse.fused_observation_attrs(obs, sources.limit(0), fusion).collect()] == [{}] * 5
    assert {r.owner: r.attrs for r in fuse.merge_attrs(sources).collect()} == {5: {"b": "2"}, 6: {"a": "4"}, 7: {}, 8: {"a": "3"}}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_lines_are_numbered_once_for_edges_and_their_attributes(spark, monkeypatch):
    plain, made = fixture.lines, []
    monkeypatch.setattr(fixture, "lines", lambda *a: made.append(1) or plain(*a))
    assert fusion_queries.fused_observation_attrs(spark, DATA).count() and fusion_queries.rebuilt_tables(spark, DATA).count() and len(made) == 2


def test_fused_entities_have_their_heads_and_meet_the_fusion_once(spark):
    entity = spark.createDataFrame([(1, "b", "person"), (2, "a", "person"), (3, None, "file"), (4, "b", "person"), (6, "x", "file")], "id long, name string, type string")
    fusion = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 1), (6, 5)], "id_other long, id_lowest long")
    sources = spark.createDataFrame([(4, 0, {"k": "1"}), (2, 9, {"k": "2"})], "owner long, src_id long, attrs map<string,string>")
    rows = fuse.fused_entities(entity, sources, fusion)
    assert sorted(map(tuple, rows.collect())) == [(1, "b", "person", {"k": "2"}, "a\nb"), (3, None, "file", {}, "")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3


def test_ends_of_a_row_meet_their_groups_and_sources_merge_in_the_row(spark, monkeypatch):
    fusion = spark.createDataFrame([(10, 10), (20, 10), (21, 21), (30, 30)], "id_other long, id_lowest long")
    rows = spark.createDataFrame([(1, 20, 21), (2, 99, 20), (3, None, 30), (4, 20, None)], "k long, x long, y long")
    want = [(1, 10, 21), (2, None, 10), (3, None, 30), (4, 10, None)]
    assert sorted(map(tuple, fuse.grouped_ends(rows, fusion, ["x", "y"]).collect())) == want
    monkeypatch.setattr(fuse, "FEW_GROUPS", 0)
    assert sorted(map(tuple, fuse.grouped_ends(rows, fusion, ["x", "y"]).collect())) == want
    assert [tuple(r) for r in fuse.grouped_ends(rows.filter("k = 3"), fusion, ["x"]).collect()] == [(3, None, 30)] and not fuse.grouped_ends(rows.limit(0), fusion, ["x"]).count()
    given = [(1, [(1, {"a": "null", "c": None}), (0, {"a": "1", "b": "2"})]), (2, [(0, {})]), (3, [None, (0, {"a": "3"}), (5, None)]), (4, [(7, {"a": "x"}), (7, {"a": "y"}), (2, {"a": "z"})]), (5, [])]
    carried = spark.createDataFrame(given, "owner long, sources array<struct<src_id:int,attrs:map<string,string>>>")
    got = {r.owner: r.attrs for r in carried.select("owner", fuse.merged_maps(F.col("sources")).alias("attrs")).collect()}
    assert got == {1: {"b": "2"}, 2: {}, 3: {"a": "3"}, 4: {"a": "y"}, 5: {}}
    apart = {r.owner: r.attrs for r in fuse.merge_attrs(carried.select("owner", F.explode("sources").alias("s")).select("owner", "s.*")).collect()}
    assert got == apart | {5: {}}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_lines_are_dealt_by_order_once_for_their_number_and_group(spark, monkeypatch):
    monkeypatch.setattr(fuse, "FEW_GROUPS", 0)
    plan = fusion_queries.fused_observation_attrs(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    by = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert plan.count("lineitem.parquet") == 1
    assert sum(x.startswith("order_id") for x in by) == 2  # the lines and the groups
    assert not any(x.startswith(("owner", "l_orderkey", "l_linenumber")) for x in by)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_edges_made_after_the_groups_equal_those_by_the_general_operator(spark):
    fusion = fusion_queries.stored_groups(fusion_queries.fusion(spark, DATA)).filter("id_other % 7 <> 3")
    general = fuse.fused_observation_attrs(fixture.observations(spark, DATA), fusion_queries.line_sources(fixture.lines(spark, DATA)), fusion)
    rows = lambda df: sorted((*r[:6], sorted(r.attrs.items())) for r in df.select("id", "batch_id", "type", "time", "src_id", "dst_id", "attrs").collect())
    assert rows(general) == rows(fusion_queries.fused_edges(spark, DATA, fusion))

"""Attributes, labels and statuses on odd rows."""

import datetime as dt

from pyspark.sql import functions as F

from weftline.operators import entities
from weftline.plans import reports


def test_attributes_of_every_shape(spark):
    values = ['"a\\"b"', '""', "null", "false", "0", "-0.0", "0.5", "[]", "[ ]", "{}", '[0]', '{"a":null}', '" "', "true", None]
    df = spark.createDataFrame([(i, {"k": v, "other": "1"}) for i, v in enumerate(values)] + [(99, {}), (100, None)], "i int, attrs map<string,string>")
    got = {r["i"]: (r["t"], r["s"], r["v"]) for r in df.select("i", entities.is_text(F.col("attrs"), "k").alias("t"), entities.is_set(F.col("attrs"), "k").alias("s"), entities.attr(F.col("attrs"), "k").alias("v")).collect()}
    assert [got[i][1] for i in range(15)] == [True] + [False] * 5 + [True] + [False] * 3 + [True] * 4 + [False]
    assert [i for i in got if got[i][0]] == [0, 1, 12] and got[2][0] is None and got[14][0] is None and got[99] == got[100] == (None, False, None)
    assert [got[i][2] for i in (0, 1, 2, 6, 10)] == ['a"b', "", None, "0.5", "[0]"]


def test_prefixes_end_at_their_part(spark):
    df = spark.createDataFrame([(1, {"n_body": "1", "n_body_x": "2", "n_bodyguard": "4", "m_body": "8", "n_sign_y": "x"}), (2, {}), (3, None)], "id int, attrs map<string,string>")
    rows = entities.prefix_totals(df, "n_").withColumn("all", entities.prefix_total(F.col("attrs"), "n_"))
    got = {r["id"]: (r["body"], r["quote"], r["sign"], r["all"]) for r in rows.collect()}
    assert got[1] == (3.0, 0.0, 0.0, 7.0) and got[2] == (0.0, 0.0, 0.0, 0.0)


def test_labels_of_the_unknown(spark):
    fused = spark.createDataFrame([(1, "person", "Ann"), (2, "file", None)], "id long, type string, name string")
    assert sorted(map(tuple, entities.labels(spark.createDataFrame([(1,), (1,), (2,), (3,)], "id long"), fused).collect())) == [(1, "<1: person Ann>"), (2, "<2: file none>"), (3, None)]
    obs = spark.createDataFrame([(7, "created", dt.datetime(2020, 2, 3, 23), 1, 9), (8, "created", None, 9, 9)], "id long, type string, time timestamp_ntz, src_id long, dst_id long")
    assert sorted(map(tuple, entities.labelled_edges(obs, fused).collect())) == [(7, "<7: (created)@2020-02-03, <1: person Ann>, 9>"), (8, "<8: (created), 9, 9>")]


def test_lookup_and_contributors(spark):
    entity = spark.createDataFrame([(1, 5, "Ann", "person"), (2, 6, "Anne", "person")], "id long, batch_id long, name string, type string")
    fusion = spark.createDataFrame([(1, 1, "no match"), (2, 1, "name match: ann")], "id_other long, id_lowest long, comment string")
    batches = spark.createDataFrame([(5, "x")], "batch_id long, resource string")
    got = entities.lookup(spark.createDataFrame([(1,), (4,)], "id long"), entity, fusion, entity, batches).collect()
    assert sorted((r["id"], r["member_id"] or 0, r["resource"]) for r in got if r["member_id"] != 2) == [(1, 1, "x"), (4, 0, None)]
    assert [(r["label"], r["comment"]) for r in got if r["member_id"] == 2] == [("<1: person Ann>", "name match: ann")]
    sources = spark.createDataFrame([(2, 20, {"a": "1"}), (1, 10, {"a": "2"}), (3, 30, {})], "owner long, src_id long, attrs map<string,string>")
    ids = spark.createDataFrame([(1,), (1,)], "id long")
    assert sorted((r["id"], r["src_id"]) for r in entities.contributors(ids, sources, fusion).collect()) == [(1, 10), (1, 20)]
    assert [r["src_id"] for r in entities.contributors(ids, sources).collect()] == [10]


def test_success_and_means(spark):
    at = dt.datetime(2020, 1, 1)
    made = spark.createDataFrame([(1, at, "Final"), (1, at, ""), (1, at, None), (1, at, "Rejected"), (2, at, "Draft")], "seed long, time timestamp_ntz, status string")
    got = reports.success(made).collect()
    assert {(r["seed"], r["n_year"], r["success"]) for r in got} == {(1, 4, 5.5), (2, 1, 1.0)} and len(got) == 5
    stats = spark.createDataFrame([(1, 1, 2.0), (2, 1, 4.0), (3, 1, None), (4, 1, 9.0)], "id long, hop int, m double")
    works = spark.createDataFrame([(1, "Final"), (2, "Final"), (3, "Rejected"), (4, "Draft")], "id long, status string")
    assert [tuple(r) for r in reports.good_bad_means(stats, works, ["m"]).collect()] == [(1, "m", 2, 0, 3.0, None)]
    authors = spark.createDataFrame([(a, n, 0, 1, 0) for a, n in [(1, 3), (2, 3), (3, 5)]], "author long, n long, n_good long, n_bad long, n_other long")
    assert [r["author"] for r in reports.top_authors(authors, 2).collect()] == [3, 1] and [r["author"] for r in reports.other_authors(authors, 2).collect()] == [2]
    assert reports.top_authors(authors, 1).first()["bad_to_good"] is None

"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from weftline.plans import registry

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(registry.SQL[name]).df()
    got = registry.QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    columns = sorted(got.columns)
    whole = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v  # noqa: E731  a column with nulls comes as floats
    rows = lambda df: sorted(str([whole(v) for v in r]) for r in df[columns].astype(object).where(df[columns].notna(), None).values.tolist())
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_whole_fusion_has_every_entity_and_edge(spark):
    from weftline.plans import fixture

    run = lambda name: [tuple(r) for r in registry.QUERIES[name](spark, DATA).collect()]
    whole, part, types = run("entity_fusion_whole"), run("entity_fusion"), {r["id"]: r["type"] for r in fixture.entities(spark, DATA).collect()}
    assert sorted(r[0] for r in whole) == sorted(types) and len(whole) == len(part) and {r[1] for r in whole} < {r[0] for r in whole}
    label, edges = {r[0]: r[1] for r in whole}, fixture.observations(spark, DATA).select("id", "src_id", "dst_id").collect()
    assert sorted(run("fused_observation_whole")) == sorted((i, label[a], label[b]) for i, a, b in edges if a in label and b in label)
    assert {r["id"] for r in registry.QUERIES["fused_entity_whole"](spark, DATA).collect()} == set(label.values())
    assert registry.QUERIES["fused_observation"](spark, DATA).count() == len(edges)

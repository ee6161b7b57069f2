"""Queries of features, work statistics and further reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import graph, targets

from . import fixture, graph_queries, report_queries, reports
from .fixture import with_tables

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


KEYS = ["size_0", "size_1", "size_2", "size_3"]
_wide = ", ".join(f"coalesce(sum(p_size) FILTER (WHERE p_size % 4 = {k}), 0)::DOUBLE AS size_{k}" for k in range(4))
_scaled = ", ".join(f"round((size_{k} - min(size_{k}) FILTER (WHERE part = 'train') OVER ()) / nullif(max(size_{k}) FILTER (WHERE part = 'train') OVER () - min(size_{k}) FILTER (WHERE part = 'train') OVER (), 0), 6) AS size_{k}" for k in range(4))


@query(f"""{graph_queries._near},
m AS (SELECT seed AS id, {_wide} FROM n JOIN part ON 5000000000000 + p_partkey = n.id GROUP BY seed HAVING sum(p_size) > 0),
d AS (SELECT m.*, c_acctbal AS target, CASE WHEN CAST('0x' || substr(md5('0:' || m.id), 1, 8) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END AS part FROM m JOIN customer ON 1000000000000 + c_custkey = m.id)
SELECT id, {_scaled}, target, part FROM d""")
def feature_matrix(spark, d):
    sums = graph_queries.neighbour_sums(spark, d)
    target = fixture.table(spark, d, "customer").select((F.lit(fixture.CUSTOMER) + F.col("c_custkey")).cast("long").alias("id"), F.col("c_acctbal").alias("target"))
    return targets.feature_matrix(sums, target, KEYS).withColumns({k: F.round(k, 6) for k in KEYS})


@query(f"""{graph_queries._near},
s AS (SELECT seed AS id, list(round(p_retailprice / 3, 4) ORDER BY p_retailprice DESC) AS v FROM n JOIN part ON 5000000000000 + p_partkey = n.id WHERE n.id <> seed GROUP BY seed)
SELECT id, round(list_avg(v[1:CAST(ceil(0.1 * len(v)) AS INT)]), 6) AS score, round(log10(1 + least(abs(c_acctbal), 5000.0::DOUBLE)), 6) AS target FROM s JOIN customer ON 1000000000000 + c_custkey = id""")
def score_against_target(spark, d):
    scores = fixture.table(spark, d, "part").select((F.lit(fixture.PART) + F.col("p_partkey")).cast("long").alias("id"), (F.col("p_retailprice") / 3).alias("score"))
    lists = targets.neighbour_lists(fixture.persons(spark, d), graph_queries.inc(spark, d), scores, 2, graph_queries.W0, graph_queries.W1)
    target = fixture.table(spark, d, "customer").select((F.lit(fixture.CUSTOMER) + F.col("c_custkey")).cast("long").alias("id"), F.abs("c_acctbal").alias("target"))
    return targets.score_against(lists, target, 10, 5000, log=True).select("id", F.round("score", 6).alias("score"), F.round("target", 6).alias("target"))


@query(f"""{with_tables('incidence')},
w AS (SELECT 4000000000000 + o_orderkey AS id FROM orders),
v AS (SELECT 5000000000000 + p_partkey AS id, p_size AS terms, p_size + 7 AS words FROM part),
n AS (SELECT DISTINCT w.id AS seed, i.other_id AS id FROM w JOIN incidence i ON i.id = w.id)
SELECT seed AS id, 1 AS hop, count(*) AS n_texts, sum(words)::BIGINT AS n_words, sum(terms)::BIGINT AS total, round(list_avg(list(terms / words::DOUBLE ORDER BY terms / words::DOUBLE DESC)[1:CAST(ceil(0.1 * count(*)) AS INT)]), 9) AS top,
  round(sum(terms) / count(*)::DOUBLE, 9) AS per_text, round(sum(terms) / sum(words)::DOUBLE, 9) AS per_word FROM n JOIN v USING (id) GROUP BY seed""")
def work_stats(spark, d):
    works = fixture.table(spark, d, "orders").select((F.lit(fixture.ORDER) + F.col("o_orderkey")).cast("long").alias("id"))
    values = fixture.table(spark, d, "part").select((F.lit(fixture.PART) + F.col("p_partkey")).cast("long").alias("id"), F.col("p_size").cast("long").alias("terms"), (F.col("p_size") + 7).cast("long").alias("words"))
    rows = targets.work_stats(works, graph_queries.inc(spark, d), values, (1,))
    return rows.withColumns({c: F.round(c, 9) for c in ("top", "per_text", "per_word")})


@query(f"""{with_tables('incidence')},
w AS (SELECT 4000000000000 + o_orderkey AS id FROM orders),
v AS (SELECT 5000000000000 + p_partkey AS id, p_size AS terms, p_size + 7 AS words FROM part),
h1 AS (SELECT DISTINCT w.id AS seed, i.other_id AS id FROM w JOIN incidence i ON i.id = w.id),
n AS (SELECT seed, id, 1 AS hop FROM h1 UNION ALL (SELECT seed, id, 2 FROM h1 UNION SELECT h1.seed, i.other_id, 2 FROM h1 JOIN incidence i ON i.id = h1.id WHERE i.other_id <> h1.seed))
SELECT seed AS id, hop, count(*) AS n_texts, sum(words)::BIGINT AS n_words, sum(terms)::BIGINT AS total, round(list_avg(list(terms / words::DOUBLE ORDER BY terms / words::DOUBLE DESC)[1:CAST(ceil(0.1 * count(*)) AS INT)]), 9) AS top,
  round(sum(terms) / count(*)::DOUBLE, 9) AS per_text, round(sum(terms) / sum(words)::DOUBLE, 9) AS per_word FROM n JOIN v USING (id) GROUP BY seed, hop""")
def work_stats_hops(spark, d):
    works = fixture.table(spark, d, "orders").select((F.lit(fixture.ORDER) + F.col("o_orderkey")).cast("long").alias("id"))
    values = fixture.table(spark, d, "part").select((F.lit(fixture.PART) + F.col("p_partkey")).cast("long").alias("id"), F.col("p_size").cast("long").alias("terms"), (F.col("p_size") + 7).cast("long").alias("words"))
    rows = targets.work_stats(works, graph_queries.inc(spark, d), values, (1, 2))
    return rows.withColumns({c: F.round(c, 9) for c in ("top", "per_text", "per_word")})


@query(f"""{graph_queries._near},
s AS (SELECT seed AS id, list(round(p_retailprice / 3, 4) ORDER BY p_retailprice DESC) AS v FROM n JOIN part ON 5000000000000 + p_partkey = n.id WHERE n.id <> seed GROUP BY seed)
SELECT 1000000000000 + c_custkey AS id, coalesce(round(list_avg(v[1:CAST(ceil(0.1 * len(v)) AS INT)]), 6), 0) AS score, round(log10(1 + least(abs(c_acctbal), 5000.0::DOUBLE)), 6) AS target FROM customer LEFT JOIN s ON 1000000000000 + c_custkey = id""")
def score_or_default(spark, d):
    scores = fixture.table(spark, d, "part").select((F.lit(fixture.PART) + F.col("p_partkey")).cast("long").alias("id"), (F.col("p_retailprice") / 3).alias("score"))
    lists = targets.neighbour_lists(fixture.persons(spark, d), graph_queries.inc(spark, d), scores, 2, graph_queries.W0, graph_queries.W1)
    target = fixture.table(spark, d, "customer").select((F.lit(fixture.CUSTOMER) + F.col("c_custkey")).cast("long").alias("id"), F.abs("c_acctbal").alias("target"))
    return targets.score_against(lists, target, 10, 5000, log=True, default=0.0).select("id", F.round("score", 6).alias("score"), F.round("target", 6).alias("target"))


@query(f"""{with_tables('person', 'incidence')},
c AS (SELECT id FROM person WHERE name IS NOT NULL AND id IN (SELECT id FROM incidence WHERE type IN ('created', 'committed'))),
i AS (SELECT *, year(time) AS y FROM incidence WHERE year(time) IN (1996, 1997)),
h1 AS (SELECT DISTINCT c.id AS seed, i.y, i.other_id AS id FROM c JOIN i USING (id)),
n AS (SELECT seed, y, id FROM h1 UNION SELECT h1.seed, h1.y, i.other_id FROM h1 JOIN i ON i.id = h1.id AND i.y = h1.y WHERE i.other_id <> h1.seed)
SELECT seed AS id, y AS year, string_agg(printf('%.4f', round(p_retailprice / 3, 4)), ',' ORDER BY round(p_retailprice / 3, 4)) AS scores FROM n JOIN part ON 5000000000000 + p_partkey = n.id GROUP BY seed, y""")
def committer_scores_yearly(spark, d):
    made = graph_queries.inc(spark, d).filter("type in ('created', 'committed')").select("id")
    at = lambda y: F.lit(f"{y}-01-01").cast("timestamp_ntz")
    windows = F.explode(F.array(*[F.struct(at(y).alias("start"), at(y + 1).alias("end")) for y in (1996, 1997)])).alias("w")
    makers = fixture.persons(spark, d).filter("name is not null").join(made, "id", "left_semi").select("id", windows).select("id", "w.start", "w.end")
    scores = fixture.table(spark, d, "part").select((F.lit(fixture.PART) + F.col("p_partkey")).cast("long").alias("id"), (F.col("p_retailprice") / 3).alias("score"))
    lists = targets.neighbour_lists(makers, graph_queries.inc(spark, d), scores, 2)
    return lists.select("id", F.year("start").cast("long").alias("year"), F.array_join(F.transform("scores", lambda x: F.format_string("%.4f", x)), ",").alias("scores"))


@query(f"""{with_tables('person', 'incidence')},
t AS (SELECT id, count(*) AS degree FROM incidence JOIN person USING (id) GROUP BY id ORDER BY degree DESC, id LIMIT 50),
m AS (SELECT unnest(range(DATE '1995-01-01', DATE '2001-09-01', INTERVAL 1 MONTH)) AS m),
k AS (SELECT id, date_trunc('month', time) AS m, count(DISTINCT obs_id) AS n FROM incidence GROUP BY ALL)
SELECT t.id, year(m.m) || '-' || month(m.m) AS month, coalesce(n, 0) AS n FROM t CROSS JOIN m LEFT JOIN k ON k.id = t.id AND k.m = m.m""")
def top_persons_monthly(spark, d):
    return targets.top_monthly(graph_queries.inc(spark, d), fixture.persons(spark, d), 50, "1995-01-01", "2001-08-31")


@query(f"""{with_tables('observation')}
SELECT DISTINCT dst_id AS work, src_id AS person FROM observation WHERE type = 'created'
UNION SELECT 4000000000000 + event_id % 100 AS work, 3000000000000 + user_id FROM events WHERE event_type = 'error'""")
def collaborators(spark, d):
    o = fixture.observations(spark, d)
    refs = fixture.table(spark, d, "events").filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.lit(3).cast("long").alias("batch_id"), F.lit("message_ref").alias("type"), F.col("ts").alias("time"), (F.lit(fixture.EVENT) + F.col("event_id")).cast("long").alias("src_id"), (F.lit(fixture.ORDER) + F.col("event_id") % 100).cast("long").alias("dst_id"))
    return graph.collaborators(o.unionByName(refs))


@query(f"""{with_tables('observation')}, r AS (SELECT o_orderkey AS c, o_orderkey % 50 AS t FROM orders)
SELECT src_id AS person, dst_id AS "commit" FROM observation WHERE type = 'created'
UNION SELECT o.src_id, 4000000000000 + r.c FROM observation o JOIN r ON o.dst_id = 4000000000000 + r.t WHERE o.type = 'created'""")
def commits_via_requests(spark, d):
    o = fixture.observations(spark, d)
    refs = fixture.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).cast("long").alias("batch_id"), F.lit("attached_to").alias("type"), F.col("o_orderdate").alias("time"), (F.lit(fixture.ORDER) + F.col("o_orderkey")).cast("long").alias("src_id"), (F.lit(fixture.ORDER) + F.col("o_orderkey") % 50).cast("long").alias("dst_id"))
    return graph.commits_via_requests(o.unionByName(refs))


@query(r"""SELECT doc_id AS id, length(coalesce(text, '')) AS n_chars, quality AS score FROM documents LEFT JOIN labels USING (doc_id)""")
def export_texts(spark, d):
    docs = fixture.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    scores = fixture.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("score"))
    return reports.export_texts(docs, scores).select("id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "score")


@query(f"""{with_tables('incidence')}, w AS (SELECT 4000000000000 + o_orderkey AS id FROM orders),
f AS (SELECT 5000000000000 + p_partkey AS id, unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS term FROM part)
SELECT DISTINCT w.id AS seed, f.id, term FROM w JOIN incidence i ON i.id = w.id JOIN f ON f.id = i.other_id WHERE term IN ('red', 'ring')""")
def term_evidence(spark, d):
    works = fixture.table(spark, d, "orders").select((F.lit(fixture.ORDER) + F.col("o_orderkey")).cast("long").alias("id"))
    found = fixture.table(spark, d, "part").select((F.lit(fixture.PART) + F.col("p_partkey")).cast("long").alias("id"), text.term_examples(F.col("p_name"), ["red", "ring"]).alias("terms"))
    return reports.evidence(works, graph_queries.inc(spark, d), found, 1)


@query(f"""{with_tables('incidence')}, w AS (SELECT 4000000000000 + o_orderkey AS id FROM orders),
f AS (SELECT 5000000000000 + p_partkey AS id, unnest(list_distinct(regexp_extract_all(lower(p_name), '[a-z]+'))) AS term FROM part),
h1 AS (SELECT DISTINCT w.id AS seed, i.other_id AS id FROM w JOIN incidence i ON i.id = w.id),
n AS (SELECT seed, id FROM h1 UNION SELECT h1.seed, i.other_id FROM h1 JOIN incidence i ON i.id = h1.id WHERE i.other_id <> h1.seed)
SELECT seed, term, count(*) AS n, min(id) AS first_id FROM n JOIN f USING (id) WHERE term IN ('red', 'ring') GROUP BY ALL""")
def term_evidence_hops(spark, d):
    """Texts with a term within two hops of each work: how many, and the first."""
    works = fixture.table(spark, d, "orders").select((F.lit(fixture.ORDER) + F.col("o_orderkey")).cast("long").alias("id"))
    found = fixture.table(spark, d, "part").select((F.lit(fixture.PART) + F.col("p_partkey")).cast("long").alias("id"), text.term_examples(F.col("p_name"), ["red", "ring"]).alias("terms"))
    return reports.evidence(works, graph_queries.inc(spark, d), found, 2).groupBy("seed", "term").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("""SELECT CASE WHEN year(o_orderdate) <= 1997 THEN 'to 1997' WHEN year(o_orderdate) <= 1999 THEN 'to 1999' ELSE 'later' END AS era,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'good' WHEN o_orderpriority LIKE '5%' THEN 'bad' ELSE 'other' END AS status, count(*) AS n FROM orders GROUP BY ALL""")
def works_by_era(spark, d):
    o = fixture.table(spark, d, "orders").select(F.col("o_orderkey").alias("number"), F.year("o_orderdate").alias("year"))
    return reports.eras(report_queries.works(spark, d).join(o, "number"), [1997, 1999])


@query(f"WITH {report_queries._members} SELECT project, count(DISTINCT person) AS n FROM members GROUP BY project HAVING count(DISTINCT person) > 1")
def joint_works(spark, d):
    return reports.joint_works(report_queries.members(spark, d))


@query("""SELECT user_id, count(*) AS n, round(sum(CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT)), 0)::BIGINT AS total FROM events WHERE regexp_extract(props, '"k": *(-?[0-9]+)', 1) <> '' GROUP BY user_id""")
def json_attrs(spark, d):
    v = F.get_json_object("props", "$.k").cast("long")
    return fixture.table(spark, d, "events").withColumn("v", v).filter("v is not null").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("v").alias("total"))

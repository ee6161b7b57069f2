"""Queries of single entities, attributes and statuses, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import entities

from . import feature_queries, fixture, fusion_queries, report_queries, reports
from .fixture import with_tables

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def batches(spark):
    return spark.createDataFrame(list(fixture.BATCHES.items()), "batch_id long, resource string")


_batches = "batch AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in fixture.BATCHES.items()) + ") t(batch_id, resource))"
_label = "'<' || {0}.id || ': ' || {0}.type || ' ' || {0}.name || '>'"


def asked(spark, d):
    """The groups of all persons, and of each an id that no group has."""
    ids = fixture.persons(spark, d).select("id")
    return ids.unionByName(ids.select((-F.col("id")).alias("id")))


@query(f"""{fusion_queries._fused}, {_batches}, asked AS (SELECT id FROM person UNION SELECT -id FROM person),
lead AS (SELECT e.* FROM entity e WHERE e.id IN (SELECT id_lowest FROM fusion)),
why AS (SELECT a, arg_min(rule || ' match: ' || evidence, (CASE rule WHEN 'email' THEN 1 WHEN 'github_user' THEN 2 ELSE 3 END, b)) AS why FROM m GROUP BY a)
SELECT q.id, {_label.format('l')} AS label, f.id_other AS member_id, CASE WHEN f.id_other IS NOT NULL THEN coalesce(why, 'no match') END AS comment, e.batch_id, batch.resource
FROM asked q LEFT JOIN lead l ON l.id = q.id LEFT JOIN fusion f ON f.id_lowest = q.id LEFT JOIN entity e ON e.id = f.id_other LEFT JOIN batch ON batch.batch_id = e.batch_id LEFT JOIN why ON why.a = f.id_other""")
def entity_lookup(spark, d):
    entity, fusion = fixture.entities(spark, d), fusion_queries.fusion(spark, d)
    heads = entity.join(fusion.select(F.col("id_lowest").alias("id")).distinct(), "id", "left_semi")
    return entities.lookup(asked(spark, d), heads, fusion, entity, batches(spark))


@query(f"""{with_tables('entity', 'observation')}
SELECT o.id, '<' || o.id || ': (' || o.type || ')@' || strftime(o.time, '%Y-%m-%d') || ', ' || coalesce({_label.format('a')}, o.src_id::VARCHAR) || ', ' || coalesce({_label.format('b')}, o.dst_id::VARCHAR) || '>' AS label
FROM observation o LEFT JOIN entity a ON a.id = o.src_id LEFT JOIN (SELECT * FROM entity WHERE type <> 'file') b ON b.id = o.dst_id""")
def edge_labels(spark, d):
    """Labels of all edges among entities other than files, so that some ends have none."""
    return entities.labelled_edges(fixture.observations(spark, d), fixture.entities(spark, d).filter("type <> 'file'"))


@query(f"{with_tables('entity', 'attr')} SELECT type, key, count(DISTINCT owner) AS n FROM attr JOIN entity ON id = owner GROUP BY ALL")
def attr_keys_by_type(spark, d):
    return entities.keys_by_type(fixture.entities(spark, d), fixture.attr_sources(spark, d))


@query(f"""{fusion_queries._fused} SELECT id_lowest AS id, owner, src_id, string_agg(key || '=' || coalesce(value, ''), ';' ORDER BY key) AS attrs FROM attr JOIN fusion ON id_other = owner GROUP BY ALL""")
def entity_contributors(spark, d):
    """All rows of attributes behind each fused person."""
    fusion = fusion_queries.fusion(spark, d)
    rows = entities.contributors(fusion.select(F.col("id_lowest").alias("id")), fixture.attr_sources(spark, d), fusion)
    return rows.select("id", "owner", "src_id", shown("attrs").alias("attrs"))


@query(f"""{with_tables('line')}, src AS (
  SELECT 3000000000000000 + line AS id, 0 AS src_id, 'flag="' || l_returnflag || '";quantity=' || l_quantity::INT AS attrs FROM line
  UNION ALL SELECT 3000000000000000 + line, 1, 'checked=true;flag=' || CASE WHEN l_linenumber % 2 = 0 THEN 'null' ELSE '"later"' END FROM line WHERE l_linenumber > 1)
SELECT id, src_id, attrs FROM src""")
def edge_contributors(spark, d):
    """All rows of attributes behind each edge that modifies a file."""
    rows = entities.contributors(fixture.modified(spark, d), fusion_queries.line_sources(fixture.lines(spark, d)))
    return rows.select("id", "src_id", shown("attrs").alias("attrs"))


def shown(attrs):
    return F.array_join(F.transform(F.array_sort(F.map_entries(attrs)), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit("")))), ";")


def counted(spark, d):
    """Events with the counts of terms that a scan of their parts attaches: whole numbers, a fraction and a word."""
    e = fixture.table(spark, d, "events")
    k = F.col("event_id")
    counts = F.map_from_arrays(
        F.array(*[F.lit(f"terms_{x}") for x in ("body_first", "body_second", "bodyguard", "quote_first")] + [F.lit("other")]),
        F.array((k % 7).cast("string"), F.concat(k % 5, F.lit(".5")), F.lit("100"), F.when(k % 3 > 0, (k % 11).cast("string")).otherwise("null"), F.lit('"terms_sign"')),
    )
    return e.select((F.lit(fixture.EVENT) + k).cast("long").alias("id"), counts.alias("attrs"))


@query("""SELECT 7000000000000 + event_id AS id, (event_id % 7 + event_id % 5 + 0.5)::DOUBLE AS body, (CASE WHEN event_id % 3 > 0 THEN event_id % 11 ELSE 0 END)::DOUBLE AS quote, 0::DOUBLE AS sign,
  (event_id % 7 + event_id % 5 + 100.5 + CASE WHEN event_id % 3 > 0 THEN event_id % 11 ELSE 0 END)::DOUBLE AS total FROM events""")
def prefix_totals(spark, d):
    rows = entities.prefix_totals(counted(spark, d), "terms_").withColumn("total", entities.prefix_total(F.col("attrs"), "terms_"))
    return rows.select("id", "body", "quote", "sign", "total")


@query(f"""{with_tables('entity', 'observation')} SELECT o.src_id AS person, o.dst_id AS commit, o.type FROM observation o JOIN entity a ON a.id = o.src_id JOIN entity b ON b.id = o.dst_id WHERE a.type = 'person' AND b.type = 'git_commit'""")
def person_commit_edges(spark, d):
    rows = entities.edges_between(fixture.observations(spark, d), fixture.entities(spark, d), "person", "git_commit")
    return rows.select(F.col("src_id").alias("person"), F.col("dst_id").alias("commit"), "type")


@query(f"""{with_tables('entity', 'observation')} SELECT o.dst_id AS work, a.name AS author FROM observation o JOIN entity a ON a.id = o.src_id AND a.type = 'person' JOIN entity b ON b.id = o.dst_id AND b.type = 'git_commit' WHERE o.type = 'created'""")
def authors_of_works(spark, d):
    entity = fixture.entities(spark, d)
    rows = entities.edges_between(fixture.observations(spark, d), entity, "person", "git_commit", "created")
    return rows.select(F.col("src_id").alias("id"), F.col("dst_id").alias("work")).join(entity.select("id", F.col("name").alias("author")), "id").select("work", "author")


def addressed(spark, d):
    """Persons with addresses of every kind: a text, an empty one, a number, a list, a null and none at all."""
    k = F.col("id") % 6
    value = F.when(k == 0, F.concat(F.lit('"'), "email", F.lit('"'))).when(k == 1, '""').when(k == 2, "12").when(k == 3, '["a"]').when(k == 4, "null")
    return fixture.persons(spark, d).select("id", F.map_filter(F.create_map(F.lit("email"), value), lambda _, v: v.isNotNull()).alias("attrs"))


@query(f"""{with_tables('person')} SELECT id, CASE id % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'text' WHEN 2 THEN 'other' WHEN 3 THEN 'other' ELSE 'none' END AS kind, id % 6 IN (0, 2, 3) AS is_set,
  CASE id % 6 WHEN 0 THEN email WHEN 1 THEN '' WHEN 2 THEN '12' WHEN 3 THEN '["a"]' END AS value FROM person""")
def address_kinds(spark, d):
    is_text = entities.is_text(F.col("attrs"), "email")
    kind = F.when(is_text, "text").when(~is_text, "other").otherwise("none")
    return addressed(spark, d).select("id", kind.alias("kind"), entities.is_set(F.col("attrs"), "email").alias("is_set"), entities.attr(F.col("attrs"), "email").alias("value"))


@query("""SELECT 'message:' || conv_id || '.' || turn AS key FROM conversations WHERE turn % 4 IN (1, 2)""")
def flagged_messages(spark, d):
    """Messages that carry a flag of abuse, among all that the ingest of mails makes."""
    from weftline.sources import ingest

    turn = F.split("message_id", r"\.")[1].cast("int") % 4
    flag = F.when(turn == 1, "yes").when(turn == 2, "abuse").when(turn == 3, "")
    found = ingest.mail(report_queries.mails(spark, d).withColumn("flagged_abuse", flag))[0]
    return found.filter("type = 'message'").filter(entities.is_set(F.col("attrs"), "flagged_abuse")).select("key")


_status = "CASE WHEN o_orderpriority LIKE '1%' THEN 'Final' WHEN o_orderpriority LIKE '2%' THEN 'Superseded' WHEN o_orderpriority LIKE '3%' THEN '' WHEN o_orderpriority LIKE '5%' THEN 'Rejected' END"


@query(f"""WITH w AS (SELECT 1000000000000 + o_custkey AS seed, year(o_orderdate) AS year, {_status} AS status FROM orders),
y AS (SELECT seed, year, count(*) AS n_year, count(*) FILTER (WHERE status IN ('Final', 'Superseded', '')) AS good FROM w GROUP BY ALL)
SELECT seed, year, status, count(*) AS n, n_year::BIGINT AS n_year, round(1 + 9 * good / n_year::DOUBLE, 9) AS success FROM w JOIN y USING (seed, year) GROUP BY seed, year, status, n_year, good""")
def creator_success(spark, d):
    p = F.substring("o_orderpriority", 1, 1)
    status = F.when(p == "1", "Final").when(p == "2", "Superseded").when(p == "3", "").when(p == "5", "Rejected")
    made = fixture.table(spark, d, "orders").select((F.lit(fixture.CUSTOMER) + F.col("o_custkey")).cast("long").alias("seed"), F.col("o_orderdate").alias("time"), status.alias("status"))
    return reports.success(made).withColumn("success", F.round("success", 9))


@query(f"WITH {report_queries._stats} SELECT author, n, n_good, n_bad, n_other, round(n_bad / nullif(n_good, 0)::DOUBLE, 1) AS bad_to_good FROM s ORDER BY n DESC, author LIMIT 40")
def top_authors(spark, d):
    return reports.top_authors(report_queries.author_stats(spark, d))


@query(f"WITH {report_queries._stats} SELECT author, n, n_good, n_bad, n_other FROM s ORDER BY n DESC, author OFFSET 40")
def other_authors(spark, d):
    return reports.other_authors(report_queries.author_stats(spark, d))


@query(f"""WITH s AS ({feature_queries.SQL['work_stats_hops']}), w AS (SELECT 4000000000000 + o_orderkey AS id, CASE WHEN o_orderpriority LIKE '1%' THEN 'good' WHEN o_orderpriority LIKE '5%' THEN 'bad' END AS q FROM orders),
r AS (SELECT hop, q, unnest(['top', 'per_text', 'per_word']) AS measure, unnest([top, per_text, per_word]) AS v FROM s JOIN w USING (id) WHERE q IS NOT NULL)
SELECT hop, measure, count(v) FILTER (WHERE q = 'good') AS n_good, count(v) FILTER (WHERE q = 'bad') AS n_bad, round(avg(v) FILTER (WHERE q = 'good'), 6) AS good, round(avg(v) FILTER (WHERE q = 'bad'), 6) AS bad FROM r WHERE v IS NOT NULL GROUP BY ALL""")
def good_bad_means(spark, d):
    works = report_queries.works(spark, d).select((F.lit(fixture.ORDER) + F.col("number")).cast("long").alias("id"), "status")
    rows = reports.good_bad_means(feature_queries.work_stats_hops(spark, d), works, ["top", "per_text", "per_word"])
    return rows.withColumns({"good": F.round("good", 6), "bad": F.round("bad", 6)})

"""Queries of ingest and stores, compared row by row, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.sources import ingest, store

from . import fixture, report_queries
from .fixture import with_tables

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def rows_of(edges):
    """(type, src, dst, day, n): edges by what they hold."""
    return edges.groupBy("type", "src", "dst", F.date_format("time", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


_commits = """c AS (SELECT o_orderkey AS k, 'person:' || o_custkey || ' <' || o_custkey || '@x.org>' AS who, 'git_commit:' || left(sha1(o_orderkey::VARCHAR), 10) AS key, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)"""


@query(f"""WITH {_commits}, e AS (SELECT unnest(['created', 'committed']) AS type, who AS src, key AS dst, day FROM c
UNION ALL SELECT 'modified', key, 'file:' || l_partkey, day FROM lineitem JOIN c ON k = l_orderkey)
SELECT type, src, dst, day, count(*) AS n FROM e GROUP BY ALL""")
def git_edge_rows(spark, d):
    return rows_of(ingest.git(report_queries.commits(spark, d))[1])


@query("""WITH l AS (SELECT l_partkey, sum(l_quantity::INT) AS lines FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL) SELECT 'file:' || l_partkey AS file, lines::BIGINT AS lines FROM l""")
def git_lines_by_file(spark, d):
    edges = ingest.git(report_queries.commits(spark, d))[1].filter("type = 'modified'")
    return edges.groupBy(F.col("dst").alias("file")).agg(F.sum(F.col("attrs")["insertions"].cast("long")).alias("lines"))


@query("""WITH m AS (SELECT role, 'message:' || conv_id || '.' || turn AS key, conv_id, turn FROM conversations),
e AS (SELECT 'message_from' AS type, 'person:' || role || ' <' || role || '@host.org>' AS src, key AS dst FROM m UNION ALL SELECT 'message_ref', key, 'message:' || conv_id || '.' || (turn - 1) FROM m WHERE turn > 0)
SELECT type, src, dst, '2020-01-01' AS day, count(*) AS n FROM e GROUP BY ALL""")
def mail_edge_rows(spark, d):
    return rows_of(ingest.mail(report_queries.mails(spark, d))[1])


def requests(spark, d):
    """Orders as pull requests: some merged, some with a comment (every second of them without an author) or a review
    with a reply."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda head, col: F.concat(F.lit(head), col.cast("string"))
    none = F.lit(None).cast("string")
    who = lambda name, email, login: F.struct(name.alias("name"), email.alias("email"), login.alias("login"))
    said = lambda author, body: F.struct(author.alias("author"), body.alias("bodyText"), F.col("o_orderdate").alias("publishedAt"))
    author = who(text("C", c), F.when(c % 3 != 0, F.concat(text("c", c), F.lit("@x.org"))), F.when(c % 2 == 0, text("gh", c)))
    guest = F.when(k % 8 != 0, who(none, none, text("gh", k % 10)))
    review = F.struct(text("r", k).alias("id"), author.alias("author"), F.lit("fine").alias("bodyText"), F.col("o_orderdate").alias("publishedAt"), F.array(said(author, text("re", k))).alias("comments"))
    parts = fixture.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.struct(text("l", F.col("l_partkey")).alias("oid"), F.lit("m").alias("message"))).alias("commits"))
    return fixture.table(spark, d, "orders").join(parts, "o_orderkey", "left").select(
        k.alias("number"), F.col("o_orderpriority").alias("bodyText"), F.col("o_orderdate").alias("publishedAt"), author.alias("author"),
        F.when(F.col("o_orderstatus") == "F", F.struct(text("m", k).alias("oid"))).alias("mergeCommit"), "commits",
        F.when(k % 4 == 0, F.array(said(guest, text("c", k)))).alias("comments"), F.when(k % 5 == 0, F.array(review)).alias("reviews"),
    )


_requests = """p AS (SELECT o_orderkey AS k, 'github_pullrequest:shop PR ' || o_orderkey AS pr, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus = 'F' AS merged,
  concat_ws(' ', 'C' || o_custkey, CASE WHEN o_custkey % 3 <> 0 THEN '<c' || o_custkey || '@x.org>' END, CASE WHEN o_custkey % 2 = 0 THEN '<GH gh' || o_custkey || '>' END) AS who FROM orders),
m AS (SELECT k, pr AS target, day, CASE WHEN k % 8 <> 0 THEN '<GH gh' || (k % 10) || '>' END AS who, 'c' || k AS body FROM p WHERE k % 4 = 0
  UNION ALL SELECT k, 'github_review:shop r' || k, day, who, 're' || k FROM p WHERE k % 5 = 0),
msg AS (SELECT *, 'message:Message <' || coalesce(who, '') || '> hash ' || sha256(body) AS key FROM m)"""


@query(f"""WITH {_requests}, e AS (
  SELECT 'created' AS type, 'person:' || who AS src, pr AS dst, day FROM p UNION ALL SELECT 'merged_as', pr, 'git_commit:m' || k, day FROM p WHERE merged
  UNION ALL SELECT DISTINCT 'attached_to', 'git_commit:l' || l_partkey, pr, day FROM p JOIN lineitem ON l_orderkey = k
  UNION ALL SELECT 'attached_to', 'github_review:shop r' || k, pr, day FROM p WHERE k % 5 = 0 UNION ALL SELECT 'created', 'person:' || who, 'github_review:shop r' || k, day FROM p WHERE k % 5 = 0
  UNION ALL SELECT 'message_to', key, target, day FROM msg UNION ALL SELECT 'message_from', 'person:' || who, key, day FROM msg WHERE who IS NOT NULL)
SELECT type, src, dst, day, count(*) AS n FROM e GROUP BY ALL""")
def request_edge_rows(spark, d):
    return rows_of(ingest.pull_requests(requests(spark, d), "shop")[1])


@query(f"""WITH {_requests}, e AS (
  SELECT 'person' AS type, 'person:' || who AS key FROM p UNION SELECT 'person', 'person:' || who FROM msg WHERE who IS NOT NULL UNION SELECT 'github_pullrequest', pr FROM p
  UNION SELECT 'git_commit', 'git_commit:l' || l_partkey FROM lineitem JOIN p ON k = l_orderkey UNION SELECT 'git_commit', 'git_commit:m' || k FROM p WHERE merged
  UNION SELECT 'github_review', 'github_review:shop r' || k FROM p WHERE k % 5 = 0 UNION SELECT 'message', key FROM msg) SELECT * FROM e""")
def request_entities(spark, d):
    return ingest.pull_requests(requests(spark, d), "shop")[0].select("type", "key")


_values = """v AS (SELECT 'person:' || who AS key, unnest(['name', 'email', 'github_user']) AS attr, unnest([to_json('C' || c), CASE WHEN c % 3 <> 0 THEN to_json('c' || c || '@x.org') ELSE 'null' END, CASE WHEN c % 2 = 0 THEN to_json('gh' || c) ELSE 'null' END])::VARCHAR AS value FROM (SELECT p.*, o_custkey AS c FROM p JOIN orders ON o_orderkey = k)
  UNION SELECT 'person:' || who, unnest(['name', 'email', 'github_user']), unnest(['null', 'null', '"gh' || (k % 10) || '"']) FROM p2
  UNION SELECT pr, unnest(['github_pr_number', 'body_text', 'created']), unnest([k::VARCHAR, to_json(o_orderpriority)::VARCHAR, epoch(o_orderdate)::BIGINT::VARCHAR]) FROM p JOIN orders ON o_orderkey = k
  UNION SELECT 'git_commit:l' || l_partkey, 'commit_sha', '"l' || l_partkey || '"' FROM lineitem JOIN p ON k = l_orderkey UNION SELECT 'git_commit:m' || k, 'commit_sha', '"m' || k || '"' FROM p WHERE merged
  UNION SELECT 'github_review:shop r' || k, unnest(['id', 'body_text']), unnest(['"r' || k || '"', '"fine"']) FROM p WHERE k % 5 = 0 UNION SELECT key, 'body_text', to_json(body)::VARCHAR FROM msg)"""


@query(f"""WITH {_requests}, p2 AS (SELECT k, who FROM m WHERE who LIKE '<GH gh%' AND body LIKE 'c%'), {_values} SELECT * FROM v""")
def request_attrs(spark, d):
    """Entities of requests with their attributes."""
    return ingest.pull_requests(requests(spark, d), "shop").entities.select("key", F.explode("attrs").alias("attr", "value"))


@query("""SELECT 'github_pullrequest:shop PR ' || o_orderkey AS key, 'body_text' AS attr, 2::BIGINT AS n FROM orders WHERE o_orderkey % 6 = 0""")
def request_conflicts(spark, d):
    """Requests that stand in the source twice, with other texts."""
    r = requests(spark, d)
    return ingest.pull_requests(r.unionByName(r.filter("number % 6 = 0").withColumn("bodyText", F.concat("bodyText", F.lit("!")))), "shop").conflicts


def nested_requests(spark, d):
    """The same requests with logins in a struct `user`, and commits with their people and dates."""
    nested = lambda a: F.when(a.isNotNull(), F.struct(a["name"].alias("name"), a["email"].alias("email"), F.struct(a["login"].alias("login")).alias("user")))
    said = lambda m: F.struct(nested(m["author"]).alias("author"), m["bodyText"].alias("bodyText"), m["publishedAt"].alias("publishedAt"))
    review = lambda x: F.struct(x["id"].alias("id"), nested(x["author"]).alias("author"), x["bodyText"].alias("bodyText"), x["publishedAt"].alias("publishedAt"), F.transform(x["comments"], said).alias("comments"))
    who = lambda name, login: F.struct(name.alias("name"), F.lit(None).cast("string").alias("email"), F.lit("2001-02-03T04:05:06").alias("date"), F.struct(login.alias("login")).alias("user"))
    commit = lambda c: F.struct(c["oid"].alias("oid"), who(F.concat(F.lit("By "), c["oid"]), F.concat(F.lit("by-"), c["oid"])).alias("author"), F.when(c["oid"].endswith("7"), who(F.lit("Web"), F.lit("web"))).alias("committer"))
    return requests(spark, d).select("number", "bodyText", "publishedAt", nested(F.col("author")).alias("author"), "mergeCommit", F.transform("commits", commit).alias("commits"), F.transform("comments", said).alias("comments"), F.transform("reviews", review).alias("reviews"))


@query(f"""WITH {_requests}, e AS (SELECT 'person:' || who AS key FROM p UNION SELECT 'person:' || who FROM msg WHERE who IS NOT NULL
  UNION SELECT 'person:By l' || l_partkey || ' <GH by-l' || l_partkey || '>' FROM lineitem JOIN p ON k = l_orderkey UNION SELECT 'person:Web <GH web>' FROM lineitem JOIN p ON k = l_orderkey WHERE l_partkey % 10 = 7)
SELECT key, '"' || regexp_extract(key, '<GH (.*)>$', 1) || '"' AS login FROM e""")
def request_persons(spark, d):
    """Persons of requests of the other shape, those of commits among them."""
    e = ingest.pull_requests(nested_requests(spark, d), "shop").entities.filter("type = 'person'")
    return e.select("key", F.when(F.col("attrs")["github_user"] == "null", '""').otherwise(F.col("attrs")["github_user"]).alias("login"))


@query(f"""WITH {_requests} SELECT 'git_commit:l' || l_partkey AS src, pr AS dst, '2001-02-03' AS day FROM p JOIN lineitem ON l_orderkey = k GROUP BY ALL""")
def request_commit_dates(spark, d):
    edges = ingest.pull_requests(nested_requests(spark, d), "shop").observations.filter("type = 'attached_to' and src like 'git_commit:%'")
    return edges.select("src", "dst", F.date_format("time", "yyyy-MM-dd").alias("day"))


def proposal_sources(spark, d):
    """(index, pages, authors): orders as proposals with texts, customers as their authors."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    line = lambda name, value: F.concat(F.lit(f"\n{name}: "), value)
    orders = fixture.table(spark, d, "orders")
    text = F.concat(
        F.lit("\n"), F.concat(F.lit("PEP: "), k), line("Title", F.lit("About\n  this : and that")), line("Status", F.lit("Draft")), line("Status", F.when(k % 3 == 0, "Final").otherwise("Active")), line("Type", F.lit("Process")),
        F.lit("\nno field"), line("Created", F.date_format("o_orderdate", "dd-MMM-yyyy")), F.when(k % 7 == 0, F.concat(F.lit("\nReplaces: "), k - 1, F.lit("\n\t"), k - 2)).otherwise(""), F.when(k % 11 == 0, line("Superseded-By", (k + 1).cast("string"))).otherwise(""), F.lit("\n \nRequires: 9\nAbstract: none\n"),
    )
    index = orders.select(k.alias("number"), F.lit("u").alias("url"), F.lit("t").alias("title"), F.concat(F.lit("Last"), c, F.when(k % 2 == 0, ", GvR").otherwise(""), F.when(k % 5 == 0, ", Nobody").otherwise("")).alias("authors"))
    own = fixture.table(spark, d, "customer").select(F.col("c_custkey").alias("place"), F.concat(F.lit("Last"), "c_custkey", F.when(F.col("c_custkey") % 4 != 0, ", First").otherwise(""), F.when(F.col("c_custkey") % 8 == 1, ", Jr").otherwise("")).alias("name"), F.when(F.col("c_custkey") % 3 == 0, "\u00a0").otherwise(F.concat(F.lit("c"), "c_custkey", F.lit(" at x.org"))).alias("email"))
    special = own.filter("place = 1").select(F.lit(0).cast("long").alias("place"), F.lit("Rossum, Guido (GvR)").alias("name"), F.lit("g at x.org").alias("email"))
    return index, orders.filter("o_orderkey % 13 <> 0").select(k.alias("number"), text.alias("text")), own.withColumn("place", F.col("place").cast("long")).unionByName(special)


_proposals = """p AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 13 <> 0 AS has, strftime(o_orderdate, '%d-%b-%Y') AS created FROM orders),
r AS (SELECT k AS number, CASE WHEN has THEN 'Process' ELSE '' END AS type, CASE WHEN NOT has THEN '' WHEN k % 3 = 0 THEN 'Final' ELSE 'Active' END AS status,
  trim(replace(CASE WHEN c % 4 <> 0 THEN 'First' ELSE '' END || ' Last' || c || ' ' || CASE WHEN c % 8 = 1 THEN 'Jr' ELSE '' END || ' <' || CASE WHEN c % 3 = 0 THEN '' ELSE 'c' || c || '@x.org' END || '>' || CASE WHEN k % 2 = 0 THEN '; Guido Rossum  <g@x.org>' ELSE '' END, '  ', ' ')) AS authors,
  CASE WHEN has THEN created ELSE '' END AS created, CASE WHEN has AND k % 7 = 0 THEN (k - 1) || ' ' || (k - 2) ELSE '' END AS replaces, CASE WHEN has AND k % 11 = 0 THEN (k + 1)::VARCHAR ELSE '' END AS superseded_by, '' AS requires FROM p)"""


@query(f"WITH {_proposals} SELECT * FROM r")
def proposal_records(spark, d):
    """Records read from an index, texts with a block of fields, and an index of authors."""
    return ingest.proposal_records(*proposal_sources(spark, d)).drop("url", "title")


def peps(spark, d):
    """Orders as proposals that replace, are replaced by and require others."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    authors = F.concat(F.lit("C"), c, F.lit(" <c"), c, F.lit("@x.org>"), F.when(k % 2 == 0, F.concat(F.lit("; Solo "), c)).otherwise(""))
    return fixture.table(spark, d, "orders").select(
        k.alias("number"), F.lit("u").alias("url"), F.lit("Process").alias("type"), F.lit("Final").alias("status"), F.lit("t").alias("title"), authors.alias("authors"), F.date_format("o_orderdate", "dd-MMM-yyyy").alias("created"),
        F.when(k % 7 == 0, F.concat_ws(" ", k - 1, k - 2)).alias("replaces"), F.when(k % 11 == 0, (k + 1).cast("string")).alias("superseded_by"), F.when(k % 5 == 0, F.concat(F.lit(" "), (k - 3).cast("string"), F.lit("  "))).alias("requires"),
    )


@query("""WITH p AS (SELECT o_orderkey AS k, o_custkey AS c, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
old AS (SELECT unnest([k - 1, k - 2]) AS old, k AS new FROM p WHERE k % 7 = 0 UNION SELECT k, k + 1 FROM p WHERE k % 11 = 0),
e AS (SELECT 'created' AS type, 'person:C' || c || ' <c' || c || '@x.org>' AS src, 'pep:' || k AS dst, day FROM p UNION ALL SELECT 'created', 'person:Solo ' || c, 'pep:' || k, day FROM p WHERE k % 2 = 0
  UNION ALL SELECT 'superseded_by', 'pep:' || old, 'pep:' || new, day FROM old JOIN p ON k = new UNION ALL SELECT 'requires', 'pep:' || k, 'pep:' || (k - 3), day FROM p WHERE k % 5 = 0)
SELECT type, src, dst, day, count(*) AS n FROM e GROUP BY ALL""")
def proposal_edge_rows(spark, d):
    return rows_of(ingest.proposals(peps(spark, d))[1])


@query(f"""{with_tables('entity', 'observation')}
SELECT 'entity' AS tab, id FROM entity WHERE batch_id = 1 UNION ALL SELECT 'observation', id FROM observation WHERE batch_id = 1""")
def kept_after_reset(spark, d):
    batches = spark.createDataFrame(list(fixture.BATCHES.items()), "id long, resource string")
    kept = store.reset_resource({"entity": fixture.entities(spark, d), "observation": fixture.observations(spark, d)}, batches, "ingest-mail", prefix=True)
    return kept["entity"].select(F.lit("entity").alias("tab"), "id").unionByName(kept["observation"].select(F.lit("observation").alias("tab"), "id"))

"""The given tables as a temporal graph: persons, commits, files, messages and the edges between them.

customer, supplier and event users are persons, orders are commits, parts are files, events and documents are
messages. An order is created by its customer, committed by its suppliers and modifies its parts; a user sends events.
Each function has its SQL twin in SQL_TABLES, so that a query's oracle starts from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CUSTOMER, SUPPLIER, USER, ORDER, PART, DOCUMENT, EVENT = (k * 10**12 for k in range(1, 8))
CREATED, COMMITTED, MODIFIED, SENT = (k * 10**15 for k in range(1, 5))
#: Resources by batch: what is loaded together.
BATCHES = {1: "ingest-git-shop", 2: "ingest-mail-suppliers", 3: "ingest-mail-events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entity(df: DataFrame, base: int, key: str, name, kind: str, batch: int) -> DataFrame:
    return df.select((F.lit(base) + F.col(key)).cast("long").alias("id"), F.lit(batch).cast("long").alias("batch_id"), name.alias("name"), F.lit(kind).alias("type"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, batch_id, name, type)."""
    t = lambda name: table(spark, sf_dir, name)
    parts = [
        _entity(t("customer"), CUSTOMER, "c_custkey", F.col("c_name"), "person", 1), _entity(t("supplier"), SUPPLIER, "s_suppkey", F.col("s_name"), "person", 2),
        _entity(t("events").select("user_id").distinct(), USER, "user_id", F.format_string("user %d", "user_id"), "person", 3), _entity(t("orders"), ORDER, "o_orderkey", F.format_string("commit %d", "o_orderkey"), "git_commit", 1),
        _entity(t("part"), PART, "p_partkey", F.col("p_name"), "file", 1), _entity(t("events"), EVENT, "event_id", F.format_string("event %d", "event_id"), "message", 3),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the id of its order and a number that tells rows of the same order and line number apart. Rows are dealt by the
    order's id alone, so that a join by it deals them no second time."""
    rows = table(spark, sf_dir, "lineitem").withColumn("order_id", (F.lit(ORDER) + F.col("l_orderkey")).cast("long"))
    order = ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    of_order = Window.partitionBy("order_id")
    again = F.row_number().over(of_order.orderBy("l_linenumber", *order)) - F.rank().over(of_order.orderBy("l_linenumber")) + 1
    return rows.withColumn("line", ((F.col("order_id") - ORDER) * 1024 + F.col("l_linenumber") * 64 + again).cast("long"))


def _edge(df: DataFrame, base: int, key: str, kind: str, time: str, src, dst, batch: int) -> DataFrame:
    return df.select((F.lit(base) + F.col(key)).cast("long").alias("id"), F.lit(batch).cast("long").alias("batch_id"), F.lit(kind).alias("type"), F.col(time).alias("time"), src.cast("long").alias("src_id"), dst.cast("long").alias("dst_id"))


def created(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge(table(spark, sf_dir, "orders"), CREATED, "o_orderkey", "created", "o_orderdate", F.lit(CUSTOMER) + F.col("o_custkey"), F.lit(ORDER) + F.col("o_orderkey"), 1)


def committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge(lines(spark, sf_dir), COMMITTED, "line", "committed", "l_shipdate", F.lit(SUPPLIER) + F.col("l_suppkey"), F.col("order_id"), 2)


def modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge(lines(spark, sf_dir), MODIFIED, "line", "modified", "l_shipdate", F.col("order_id"), F.lit(PART) + F.col("l_partkey"), 1)


def line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines with the ends of the two edges that each makes and what their attributes are made of."""
    end = lambda base, key: (F.lit(base) + F.col(key)).cast("long")
    rows = lines(spark, sf_dir)
    return rows.select("line", "l_shipdate", "order_id", end(SUPPLIER, "l_suppkey").alias("supplier_id"), end(PART, "l_partkey").alias("part_id"), F.col("l_quantity").cast("int").alias("l_quantity"), "l_returnflag", "l_linenumber")


def line_edges(rows: DataFrame, attrs) -> DataFrame:
    """The edges of rows as of `line_ends`, those that commit without attributes, those that modify with attrs; an edge with a null
    end is left out."""

    def edge(base, kind, src, dst, batch, attrs):
        cols = {"id": (F.lit(base) + F.col("line")).cast("long"), "batch_id": F.lit(batch).cast("long"), "type": F.lit(kind), "time": F.col("l_shipdate"), "src_id": F.col(src), "dst_id": F.col(dst), "attrs": attrs}
        return F.struct(*[c.alias(k) for k, c in cols.items()])

    both = F.array(edge(COMMITTED, "committed", "supplier_id", "order_id", 2, F.create_map().cast("map<string,string>")), edge(MODIFIED, "modified", "order_id", "part_id", 1, attrs))
    return rows.select(F.explode(both).alias("edge")).select("edge.*").filter("src_id is not null and dst_id is not null")


def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge(table(spark, sf_dir, "events"), SENT, "event_id", "message_from", "ts", F.lit(USER) + F.col("user_id"), F.lit(EVENT) + F.col("event_id"), 3)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, batch_id, type, time, src_id, dst_id)."""
    return created(spark, sf_dir).unionByName(committed(spark, sf_dir)).unionByName(modified(spark, sf_dir)).unionByName(sent(spark, sf_dir))


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers with the keys that resolution matches on: (id, batch_id, name, email, github_user)."""
    c = table(spark, sf_dir, "customer").select(
        (F.lit(CUSTOMER) + F.col("c_custkey")).cast("long").alias("id"), F.lit(1).cast("long").alias("batch_id"), F.col("c_name").alias("name"),
        F.expr("concat('u', cast(c_custkey div 4 as string), '@', lower(c_mktsegment), '.com')").alias("email"), F.expr("case when c_custkey % 5 = 0 then concat('gh', cast(c_custkey div 9 as string)) end").alias("github_user"),
    )
    s = table(spark, sf_dir, "supplier").select(
        (F.lit(SUPPLIER) + F.col("s_suppkey")).cast("long").alias("id"), F.lit(2).cast("long").alias("batch_id"), F.col("s_name").alias("name"),
        F.expr("concat('u', cast(s_suppkey as string), '@building.com')").alias("email"), F.lit(None).cast("string").alias("github_user"),
    )
    return c.unionByName(s)


def attr_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner, src_id, attrs map of JSON values): an entity's own attributes, and those that later batches attach to it."""
    own = table(spark, sf_dir, "customer").select(
        (F.lit(CUSTOMER) + F.col("c_custkey")).cast("long").alias("owner"), (F.lit(CUSTOMER) + F.col("c_custkey")).cast("long").alias("src_id"),
        F.create_map(F.lit("segment"), F.to_json(F.struct(F.col("c_mktsegment").alias("s"))).substr(F.lit(6), F.length("c_mktsegment") + 2), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("name"), F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))).alias("attrs"),
    )
    later = table(spark, sf_dir, "orders").select(
        (F.lit(CUSTOMER) + F.col("o_custkey")).cast("long").alias("owner"), (F.lit(ORDER) + F.col("o_orderkey")).cast("long").alias("src_id"),
        F.create_map(F.lit("priority"), F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"')), F.lit("nation"), F.expr("case when o_orderkey % 3 = 0 then 'null' when o_orderkey % 3 = 1 then cast(o_orderkey as string) else null end")).alias("attrs"),
    )
    return own.unionByName(later)


#: Common table expressions for DuckDB.
SQL_TABLES = {
    "entity": """entity AS (
  SELECT 1000000000000 + c_custkey AS id, 1::BIGINT AS batch_id, c_name AS name, 'person' AS type FROM customer
  UNION ALL SELECT 2000000000000 + s_suppkey, 2, s_name, 'person' FROM supplier
  UNION ALL SELECT DISTINCT 3000000000000 + user_id, 3, 'user ' || user_id, 'person' FROM events
  UNION ALL SELECT 4000000000000 + o_orderkey, 1, 'commit ' || o_orderkey, 'git_commit' FROM orders
  UNION ALL SELECT 5000000000000 + p_partkey, 1, p_name, 'file' FROM part
  UNION ALL SELECT 7000000000000 + event_id, 3, 'event ' || event_id, 'message' FROM events)""",
    "line": """line AS (
  SELECT *, l_orderkey * 1024 + l_linenumber * 64 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS line FROM lineitem)""",
    "observation": """observation AS (
  SELECT 1000000000000000 + o_orderkey AS id, 1::BIGINT AS batch_id, 'created' AS type, o_orderdate AS time, 1000000000000 + o_custkey AS src_id, 4000000000000 + o_orderkey AS dst_id FROM orders
  UNION ALL SELECT 2000000000000000 + line, 2, 'committed', l_shipdate, 2000000000000 + l_suppkey, 4000000000000 + l_orderkey FROM line
  UNION ALL SELECT 3000000000000000 + line, 1, 'modified', l_shipdate, 4000000000000 + l_orderkey, 5000000000000 + l_partkey FROM line
  UNION ALL SELECT 4000000000000000 + event_id, 3, 'message_from', ts, 3000000000000 + user_id, 7000000000000 + event_id FROM events)""",
    "incidence": """incidence AS (
  SELECT src_id AS id, dst_id AS other_id, id AS obs_id, type, time, 'out' AS dir FROM observation
  UNION ALL SELECT dst_id, src_id, id, type, time, 'in' FROM observation WHERE src_id <> dst_id)""",
    "person": """person AS (
  SELECT 1000000000000 + c_custkey AS id, 1::BIGINT AS batch_id, c_name AS name, 'u' || (c_custkey // 4) || '@' || lower(c_mktsegment) || '.com' AS email,
    CASE WHEN c_custkey % 5 = 0 THEN 'gh' || (c_custkey // 9) END AS github_user FROM customer
  UNION ALL SELECT 2000000000000 + s_suppkey, 2, s_name, 'u' || s_suppkey || '@building.com', NULL FROM supplier)""",
    "attr": """attr AS (
  SELECT 1000000000000 + c_custkey AS owner, 1000000000000 + c_custkey AS src_id, unnest(['segment', 'nation', 'name']) AS key,
    unnest(['"' || c_mktsegment || '"', c_nationkey::VARCHAR, '"' || c_name || '"']) AS value FROM customer
  UNION ALL SELECT 1000000000000 + o_custkey, 4000000000000 + o_orderkey, unnest(['priority', 'nation']),
    unnest(['"' || o_orderpriority || '"', CASE WHEN o_orderkey % 3 = 0 THEN 'null' WHEN o_orderkey % 3 = 1 THEN o_orderkey::VARCHAR END]) FROM orders)""",
}
NEEDS = {"observation": ["line"], "incidence": ["observation"]}


def with_tables(*names: str, recursive: bool = False) -> str:
    """The WITH clause that defines these tables and what they need."""
    found: dict[str, str] = {}

    def add(name):
        for n in NEEDS.get(name, []):
            add(n)
        found.setdefault(name, SQL_TABLES[name])

    for n in names:
        add(n)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(found.values())

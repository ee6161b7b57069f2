"""Queries of the graph operators, targets and features, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import graph, targets

from . import fixture
from .fixture import CUSTOMER, USER, with_tables

QUERIES: dict = {}
SQL: dict = {}

YEARS = range(1995, 2002)
W0, W1 = "1996-01-01 00:00:00", "1998-01-01 00:00:00"


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its own name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def obs(spark, d):
    return fixture.observations(spark, d)


def inc(spark, d):
    return graph.incidence(obs(spark, d))


def people(spark, d):
    return fixture.entities(spark, d).filter("type = 'person'").select("id")


def customers(spark, d):
    return fixture.persons(spark, d).filter(f"id < {2 * CUSTOMER}").select("id")


def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


_year_sums = ", ".join(f"count(DISTINCT CASE WHEN year(time) = {y} THEN obs_id END) AS y{y}" for y in YEARS)


@query(f"{with_tables('entity', 'incidence')} SELECT e.id, {_year_sums} FROM entity e LEFT JOIN incidence i ON i.id = e.id WHERE e.type = 'person' GROUP BY e.id")
def activity_yearly(spark, d):
    return targets.activity_yearly(inc(spark, d), people(spark, d), YEARS)


@query(f"""{with_tables('person', 'incidence')},
m AS (SELECT unnest(range(DATE '1995-01-01', DATE '2001-09-01', INTERVAL 1 MONTH)) AS m),
n AS (SELECT id, date_trunc('month', time) AS m, count(DISTINCT obs_id) AS n FROM incidence GROUP BY ALL)
SELECT p.id, year(m.m) || '-' || month(m.m) AS month, coalesce(n, 0) AS n FROM person p CROSS JOIN m LEFT JOIN n ON n.id = p.id AND n.m = m.m""")
def activity_monthly_spine(spark, d):
    return targets.activity_monthly(inc(spark, d), fixture.persons(spark, d), "1995-01-01", "2001-08-31")


def degrees(spark, d):
    """(id, degree) of persons. Ends are counted first, in the tasks that read them, so that no join sorts a row an end."""
    ends = obs(spark, d).select(F.explode(F.array("src_id", "dst_id")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree")).join(people(spark, d), "id", "left_semi")


@query(f"""{with_tables('entity', 'observation')},
e AS (SELECT src_id AS id FROM observation UNION ALL SELECT dst_id FROM observation)
SELECT e.id, count(*) AS degree FROM e JOIN entity USING (id) WHERE entity.type = 'person' GROUP BY e.id HAVING count(*) >= 10""")
def degree_of_persons(spark, d):
    return degrees(spark, d).filter("degree >= 10")


@query(f"""{with_tables('entity', 'observation')},
e AS (SELECT src_id AS id FROM observation UNION ALL SELECT dst_id FROM observation)
SELECT e.id, count(*) AS degree FROM e JOIN entity USING (id) WHERE entity.type = 'person' GROUP BY e.id ORDER BY degree DESC, e.id LIMIT 20""")
def degree_top(spark, d):
    return degrees(spark, d).orderBy(F.desc("degree"), "id").limit(20)


_gaps = """g AS (SELECT id, start, "end", CAST(floor((epoch_us("end") - epoch_us(start)) / 86400000000.0) AS BIGINT) AS days FROM (
  SELECT id, lag(time) OVER (PARTITION BY id ORDER BY time, obs_id) AS start, time AS "end" FROM incidence) WHERE start IS NOT NULL)"""


@query(f"""{with_tables('incidence')}, {_gaps}
SELECT id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime("end", '%Y-%m-%d %H:%M:%S') AS "end", days FROM g WHERE days >= 1""")
def gap_ranges(spark, d):
    return targets.gaps(inc(spark, d), 1).select("id", stamp("start").alias("start"), stamp("end").alias("end"), "days")


@query(f"""{with_tables('person', 'incidence')}, {_gaps}
SELECT p.id, count(g.id) AS n, coalesce(string_agg(strftime(start, '%Y-%m-%d'), ',' ORDER BY start, "end"), '') AS starts FROM person p LEFT JOIN g ON g.id = p.id AND days >= 183 GROUP BY p.id""")
def gap_lists(spark, d):
    rows = targets.gap_ranges(inc(spark, d), fixture.persons(spark, d), 183)
    return rows.select("id", F.size("gaps").cast("long").alias("n"), F.array_join(F.transform("gaps", lambda g: F.date_format(g["start"], "yyyy-MM-dd")), ",").alias("starts"))


_gap_sums = ", ".join(f"count(*) FILTER (WHERE year(start) = {y}) AS y{y}" for y in YEARS)
_gap_wide = f"""{with_tables('person', 'incidence')}, {_gaps},
w AS (SELECT p.id, {_gap_sums} FROM person p LEFT JOIN g ON g.id = p.id AND days >= 183 GROUP BY p.id)"""


@query(f"{_gap_wide} SELECT * FROM w")
def gaps_yearly(spark, d):
    return targets.gaps_yearly(inc(spark, d), fixture.persons(spark, d), YEARS, 183)


@query(f"{_gap_wide} SELECT id, y1997 + y1998 AS target FROM w")
def gaps_target(spark, d):
    return targets.gaps_target(gaps_yearly(spark, d), 1996)


@query(f"""{with_tables('entity', 'incidence')},
w AS (SELECT e.id, {_year_sums} FROM entity e LEFT JOIN incidence i ON i.id = e.id WHERE e.type = 'person' GROUP BY e.id),
t AS (SELECT id, (y1996 + y1997) / 2.0::DOUBLE AS p, (y1997 + y1998) / 2.0::DOUBLE AS n FROM w)
SELECT id, round(CASE WHEN p = 0 OR n > p THEN 0.0::DOUBLE ELSE 1 - n / p END, 9) AS target FROM t""")
def disengagement_target(spark, d):
    return targets.disengagement(activity_yearly(spark, d), 1996).select("id", F.round("target", 9).alias("target"))


@query(f"{with_tables('observation')} SELECT DISTINCT unnest([src_id, dst_id]) AS id FROM observation WHERE time BETWEEN TIMESTAMP '{W0}' AND TIMESTAMP '{W1}'")
def entities_in_window(spark, d):
    return graph.entities_in_window(obs(spark, d), W0, W1)


@query(f"""{with_tables('person', 'observation')},
o AS (SELECT * FROM observation WHERE time BETWEEN TIMESTAMP '{W0}' AND TIMESTAMP '{W1}')
SELECT src_id AS id, o.id AS obs_id, dst_id AS other_id, 'out' AS dir FROM o WHERE src_id IN (SELECT id FROM person)
UNION ALL SELECT dst_id, o.id, src_id, 'in' FROM o WHERE dst_id IN (SELECT id FROM person)""")
def edges_in_window(spark, d):
    return graph.edges_in_window(fixture.persons(spark, d), obs(spark, d), W0, W1).drop("time")


@query(f"""{with_tables('person', 'incidence')},
b AS (SELECT id, arg_max(obs_id, (time, obs_id)) AS prev_obs FROM incidence WHERE time < TIMESTAMP '{W0}' GROUP BY id),
a AS (SELECT id, arg_min(obs_id, (time, obs_id)) AS next_obs FROM incidence WHERE time > TIMESTAMP '{W1}' GROUP BY id)
SELECT p.id, prev_obs, next_obs FROM person p LEFT JOIN b USING (id) LEFT JOIN a USING (id)""")
def adjacent_events(spark, d):
    return graph.adjacent_events(fixture.persons(spark, d), inc(spark, d), W0, W1)


def _hops(k: int) -> str:
    one = "h1 AS (SELECT DISTINCT s.id AS seed, i.obs_id, i.other_id, 1 AS hop FROM person s JOIN i USING (id))"
    two = "h2 AS (SELECT DISTINCT h1.seed, i.obs_id, i.other_id, 2 AS hop FROM (SELECT DISTINCT seed, other_id FROM h1 WHERE other_id <> seed) h1 JOIN i ON i.id = h1.other_id)"
    union = "SELECT seed, obs_id, hop FROM h1" + (" UNION ALL SELECT seed, obs_id, hop FROM h2" if k > 1 else "")
    return f"""{with_tables('person', 'incidence')},
i AS (SELECT * FROM incidence WHERE time >= TIMESTAMP '{W0}' AND time < TIMESTAMP '{W1}'), {one}{', ' + two if k > 1 else ''},
h AS (SELECT seed, obs_id, min(hop) AS hop FROM ({union}) GROUP BY ALL)"""


def seeds(spark, d):
    return fixture.persons(spark, d).select(F.col("id").alias("seed"))


@query(f"{_hops(1)} SELECT * FROM h")
def hops_1(spark, d):
    return graph.obs_hops(seeds(spark, d), inc(spark, d), 1, W0, W1)


@query(f"{_hops(2)} SELECT * FROM h")
def hops_2(spark, d):
    return graph.obs_hops(seeds(spark, d), inc(spark, d), 2, W0, W1)


_near = f"""{_hops(2)},
n AS (SELECT seed, id, min(hop) AS hop FROM (
  SELECT h.seed, h.hop, unnest([o.src_id, o.dst_id]) AS id FROM h JOIN observation o ON o.id = h.obs_id) GROUP BY ALL)"""


@query(f"{_near} SELECT * FROM n WHERE id <> seed")
def neighbours_2(spark, d):
    return graph.neighbours(seeds(spark, d), inc(spark, d), 2, W0, W1)


def part_values(spark, d):
    return fixture.table(spark, d, "part").select((F.lit(fixture.PART) + F.col("p_partkey")).cast("long").alias("id"), F.concat(F.lit("size_"), F.col("p_size") % 4).alias("key"), F.col("p_size").cast("long").alias("value"))


@query(f"""{_near}
SELECT seed AS id, k.hop, 'size_' || (p_size % 4) AS key, CAST(sum(p_size) AS BIGINT) AS total FROM n
JOIN (VALUES (1), (2)) k(hop) ON n.hop <= k.hop JOIN part ON 5000000000000 + p_partkey = n.id GROUP BY ALL""")
def neighbour_sums(spark, d):
    return targets.neighbour_sums(fixture.persons(spark, d), inc(spark, d), part_values(spark, d), (1, 2), W0, W1)


@query(f"""{_near}
SELECT seed AS id, string_agg(v, ',' ORDER BY x) AS scores FROM (
  SELECT seed, round(p_retailprice / 3, 4) AS x, printf('%.4f', round(p_retailprice / 3, 4)) AS v FROM n JOIN part ON 5000000000000 + p_partkey = n.id WHERE n.id <> n.seed) GROUP BY seed""")
def neighbour_scores(spark, d):
    scores = fixture.table(spark, d, "part").select((F.lit(fixture.PART) + F.col("p_partkey")).cast("long").alias("id"), (F.col("p_retailprice") / 3).alias("score"))
    lists = targets.neighbour_lists(fixture.persons(spark, d), inc(spark, d), scores, 2, W0, W1)
    return lists.select("id", F.array_join(F.transform("scores", lambda x: F.format_string("%.4f", x)), ",").alias("scores"))


@query(f"""{with_tables('person', 'incidence')},
i AS (SELECT * FROM incidence WHERE time >= TIMESTAMP '{W0}' AND time < TIMESTAMP '{W1}'),
h1 AS (SELECT s.id AS seed, i.obs_id, i.other_id FROM person s JOIN i USING (id)
  QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY md5('1:1:' || s.id || ':' || i.obs_id), i.obs_id) <= 3),
f AS (SELECT DISTINCT seed, other_id FROM h1 WHERE other_id <> seed),
h2 AS (SELECT f.seed, i.obs_id FROM f JOIN i ON i.id = f.other_id
  QUALIFY row_number() OVER (PARTITION BY f.seed, i.id ORDER BY md5('1:2:' || i.id || ':' || i.obs_id), i.obs_id) <= 3)
SELECT seed, obs_id, min(hop) AS hop FROM (SELECT seed, obs_id, 1 AS hop FROM h1 UNION ALL SELECT seed, obs_id, 2 FROM h2) GROUP BY ALL""")
def sampled_hops(spark, d):
    return graph.obs_hops(seeds(spark, d), inc(spark, d), 2, W0, W1, sample=3, salt=1)


@query(f"""{with_tables('entity', 'incidence')}
SELECT a.id AS start, count(DISTINCT b.other_id) AS n_files FROM incidence a JOIN incidence b ON b.id = a.other_id JOIN entity f ON f.id = b.other_id
WHERE a.type = 'created' AND a.dir = 'out' AND b.type = 'modified' AND b.dir = 'out' AND f.type = 'file' GROUP BY a.id""")
def path_person_file(spark, d):
    ends = graph.path(customers(spark, d), inc(spark, d), fixture.entities(spark, d), [("out", ["created"], "git_commit"), ("out", ["modified"], "file")])
    return ends.groupBy("start").agg(F.count("*").alias("n_files"))


@query(f"""{with_tables('incidence')},
e AS (SELECT DISTINCT id, other_id, type, dir, year(time) AS y FROM incidence WHERE type IN ('created', 'modified')),
f AS (SELECT DISTINCT a.id AS start, a.y, b.other_id AS file FROM e a JOIN e b ON b.id = a.other_id AND b.y = a.y WHERE a.type = 'created' AND a.dir = 'out' AND b.type = 'modified' AND b.dir = 'out'),
c AS (SELECT DISTINCT start, f.y, e.other_id AS commit_id FROM f JOIN e ON e.id = f.file AND e.y = f.y WHERE e.type = 'modified' AND e.dir = 'in'),
p AS (SELECT DISTINCT start, c.y, e.other_id AS id FROM c JOIN e ON e.id = c.commit_id AND e.y = c.y WHERE e.type = 'created' AND e.dir = 'in')
SELECT start, y AS year, count(*) AS n_persons FROM p GROUP BY ALL""")
def path_person_person_yearly(spark, d):
    steps = [("out", ["created"], "git_commit"), ("out", ["modified"], "file"), ("in", ["modified"], "git_commit"), ("in", ["created"], "person")]
    ends = graph.path(customers(spark, d), inc(spark, d), fixture.entities(spark, d), steps, by=F.year("time"))
    return ends.groupBy("start", F.col("by").cast("long").alias("year")).agg(F.count("*").alias("n_persons"))


@query(f"""{with_tables('incidence')},
c AS (SELECT DISTINCT a.id AS start, a.other_id AS commit_id FROM incidence a WHERE a.type IN ('created', 'committed') AND a.dir = 'out')
SELECT start, count(DISTINCT b.other_id) AS n_files FROM c JOIN incidence b ON b.id = c.commit_id WHERE b.type = 'modified' AND b.dir = 'out' GROUP BY start""")
def files_by_either_role(spark, d):
    e, i = fixture.entities(spark, d), inc(spark, d)
    start = e.filter("type = 'person'").select("id")
    by_own = graph.path(start, i, e, [("out", ["created"], "git_commit")])
    by_other = graph.path(start, i, e, [("out", ["committed"], "git_commit")])
    commits = by_own.union(by_other).distinct().select("start", F.col("id").alias("commit_id"))
    touched = i.filter("type = 'modified' and dir = 'out'").select(F.col("id").alias("commit_id"), "other_id").distinct()
    return commits.join(touched, "commit_id").groupBy("start").agg(F.count_distinct("other_id").alias("n_files"))


@query(f"""{with_tables('incidence')}
SELECT a.id AS start, count(DISTINCT b.other_id) AS n_files FROM incidence a JOIN incidence b ON b.id = a.other_id
WHERE a.type = 'created' AND a.dir = 'out' AND b.type = 'modified' AND b.dir = 'out' GROUP BY a.id ORDER BY n_files DESC, start LIMIT 20""")
def top_touchers(spark, d):
    return path_person_file(spark, d).orderBy(F.desc("n_files"), "start").limit(20)


@query(f"""{with_tables('incidence')}
SELECT id, type, count(DISTINCT other_id) AS n_others, strftime(min(time), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(time), '%Y-%m-%d %H:%M:%S') AS last
FROM incidence GROUP BY id, type HAVING count(DISTINCT other_id) > 5""")
def neighbour_groups(spark, d):
    return graph.summarise_neighbours(inc(spark, d)).select("id", "type", "n_others", stamp("first").alias("first"), stamp("last").alias("last"))


_local = f"""{with_tables('person', 'incidence')},
i AS (SELECT * FROM incidence WHERE time >= TIMESTAMP '{W0}' AND time < TIMESTAMP '{W1}'),
h AS (SELECT DISTINCT s.id AS seed, i.obs_id FROM person s JOIN i USING (id)),
e AS (SELECT h.seed, h.obs_id, o.src_id AS src, o.dst_id AS dst FROM h JOIN observation o ON o.id = h.obs_id),
n AS (SELECT seed, id, min(obs_id) AS first_obs FROM (SELECT seed, obs_id, unnest([src, dst]) AS id FROM e) GROUP BY ALL),
x AS (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY (id <> seed)::INT, first_obs, id) - 1 AS i FROM n)"""


@query(f"""{_local},
p AS (SELECT e.seed, a.i, b.i AS j FROM e JOIN x a ON a.seed = e.seed AND a.id = src JOIN x b ON b.seed = e.seed AND b.id = dst)
SELECT seed, i, j FROM p UNION SELECT seed, j, i FROM p UNION SELECT seed, i, i FROM x""")
def adjacency(spark, d):
    return graph.adjacency(seeds(spark, d), inc(spark, d), 1, W0, W1).select("seed", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


def node_vectors(spark, d):
    parts = fixture.table(spark, d, "part").select((F.lit(fixture.PART) + F.col("p_partkey")).cast("long").alias("id"), F.array(F.col("p_size").cast("double"), F.floor("p_retailprice").cast("double")).alias("vector"))
    orders = fixture.table(spark, d, "orders").select((F.lit(fixture.ORDER) + F.col("o_orderkey")).cast("long").alias("id"), F.array(F.lit(0.0), F.floor("o_totalprice").cast("double")).alias("vector"))
    return parts.unionByName(orders)


_vectors = """f AS (SELECT 5000000000000 + p_partkey AS id, unnest([0, 1]) AS "at", unnest([p_size::DOUBLE, floor(p_retailprice)]) AS value FROM part
  UNION ALL SELECT 4000000000000 + o_orderkey, unnest([0, 1]), unnest([0.0::DOUBLE, floor(o_totalprice)]) FROM orders),
q AS (SELECT DISTINCT id, other_id FROM incidence UNION SELECT DISTINCT id, id FROM f)"""


@query(f"""{with_tables('incidence')}, {_vectors} SELECT q.id, "at", round(avg(value), 6) AS value FROM q JOIN f ON f.id = q.other_id GROUP BY ALL""")
def pooled_mean(spark, d):
    return graph.pool(node_vectors(spark, d), inc(spark, d)).select("id", "at", F.round("value", 6).alias("value"))


@query(f"""{with_tables('incidence')}, {_vectors} SELECT q.id, "at", max(value) AS value FROM q JOIN f ON f.id = q.other_id GROUP BY ALL""")
def pooled_max(spark, d):
    return graph.pool(node_vectors(spark, d), inc(spark, d), "max")


@query(f"{with_tables('incidence')} SELECT DISTINCT id, strftime(time, '%Y-%m-%d') AS day FROM incidence WHERE id >= 3000000000000 AND id < 4000000000000")
def active_dates(spark, d):
    users = inc(spark, d).filter(f"id >= {USER} and id < {USER + CUSTOMER}")
    return targets.active_dates(users).select("id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query(f"""{with_tables('person', 'observation')},
w AS (SELECT id, unnest(range(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-01', INTERVAL 730 DAY)) AS start FROM person),
c AS (SELECT w.id, start, count(*) FILTER (WHERE time < start + INTERVAL 365 DAY) AS n_in, count(*) FILTER (WHERE time >= start + INTERVAL 365 DAY) AS n_out
  FROM observation o JOIN w ON w.id = o.src_id WHERE o.type = 'created' AND time >= start AND time < start + INTERVAL 730 DAY GROUP BY ALL)
SELECT id, strftime(start, '%Y-%m-%d') AS start, n_in, n_out, round(least(0.0::DOUBLE, (0.1::DOUBLE + n_out) / (0.1::DOUBLE + n_in) - 1), 9) AS target, 1 + n_in AS weight FROM c WHERE n_in > 0""")
def window_samples(spark, d):
    windows = targets.sweep(fixture.persons(spark, d), "1995-01-01", "2001-07-31", 730)
    return targets.window_samples(obs(spark, d), windows).withColumns({"start": F.date_format("start", "yyyy-MM-dd"), "target": F.round("target", 9)})


@query(f"""{with_tables('incidence')}, {_vectors},
g AS (SELECT id, log10(1 + value) AS x FROM f WHERE "at" = 1),
p AS (SELECT DISTINCT id, other_id FROM incidence WHERE id <> other_id)
SELECT g.id, round(g.x, 6) AS own_price, count(o.id) AS n_around, round(coalesce(sum(o.x), 0), 4) AS around_sum
FROM g LEFT JOIN (SELECT p.id AS node, g.id, g.x FROM p JOIN g ON g.id = p.other_id) o ON o.node = g.id GROUP BY g.id, g.x""")
def ragged_features(spark, d):
    rows = targets.ragged_features(inc(spark, d), node_vectors(spark, d))
    price = F.aggregate(F.coalesce("around", F.array().cast("array<array<double>>")), F.lit(0.0), lambda s, v: s + v[1])
    return rows.select("id", F.round(F.col("own")[1], 6).alias("own_price"), F.coalesce(F.size("around"), F.lit(0)).cast("long").alias("n_around"), F.round(price, 4).alias("around_sum"))


@query(f"""{with_tables('entity', 'observation')},
e AS (SELECT src_id AS id FROM observation UNION ALL SELECT dst_id FROM observation),
c AS (SELECT e.id, count(*) AS degree FROM e JOIN entity USING (id) WHERE entity.type = 'person' GROUP BY e.id HAVING count(*) >= 10),
d AS (SELECT *, CAST('0x' || substr(md5('0:' || id), 1, 8) AS BIGINT) % 100 AS draw FROM c)
SELECT id, degree, CASE WHEN draw < 90 THEN 'train' WHEN draw < 95 THEN 'validate' ELSE 'test' END AS part FROM d""")
def entity_split(spark, d):
    return targets.split(degree_of_persons(spark, d), "id", {"train": 90, "validate": 5, "test": 5})


@query("""WITH RECURSIVE e AS (
  SELECT DISTINCT greatest(d.doc_id, m.k) AS a, least(d.doc_id, m.k) AS b FROM documents d JOIN (SELECT md5(coalesce(text, '')) AS h, min(doc_id) AS k FROM documents GROUP BY ALL) m ON md5(coalesce(d.text, '')) = m.h
  UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY source, n_chars // 200) FROM documents),
r AS (SELECT doc_id AS id, doc_id AS label FROM documents UNION
  SELECT CASE WHEN e.a = r.id THEN e.b ELSE e.a END, r.label FROM r JOIN e ON e.a = r.id OR e.b = r.id)
SELECT id, min(label) AS label FROM r GROUP BY id""")
def component_labels(spark, d):
    docs = fixture.table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("k"))
    same = docs.join(first, "h").select(F.col("doc_id").alias("a"), F.col("k").alias("b"))
    sized = fixture.table(spark, d, "documents").select("doc_id", "source", F.expr("n_chars div 200").alias("size"))
    near = sized.join(sized.groupBy("source", "size").agg(F.min("doc_id").alias("b")), ["source", "size"]).select(F.col("doc_id").alias("a"), "b")
    return graph.components(same.union(near), docs.select("doc_id"))


@query(f"""{with_tables('observation')},
t AS (SELECT DISTINCT src_id AS id, time FROM observation UNION SELECT dst_id, time FROM observation)
SELECT id, year(time) AS year, count(*) AS n FROM t GROUP BY ALL""")
def distinct_times_yearly(spark, d):
    o = obs(spark, d)
    times = o.select(F.col("src_id").alias("id"), "time").union(o.select("dst_id", "time")).distinct()
    return times.groupBy("id", F.year("time").cast("long").alias("year")).agg(F.count("*").alias("n"))


@query(f"{with_tables('entity')} SELECT id, name FROM entity WHERE id::VARCHAR = '4000000000010' OR regexp_matches(name, 'commit 1[0-9]?$', 'i') ORDER BY (id = 4000000000010) DESC, id LIMIT 10")
def search_entities(spark, d):
    pattern = "commit 1[0-9]?$"
    return graph.search(fixture.entities(spark, d), pattern, 10, "name", entity_id=4000000000010).select("id", "name")

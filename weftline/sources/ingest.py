"""Source records to entities and observations. Every ingest returns (entities, observations, conflicts):
entities (key, type, name, attrs map), observations (src, dst, type, time, attrs map) whose ends are "type:key",
conflicts (key, attr, n) to keep with the batch. A strict ingest raises in the plan instead, where the entities are read.

Ids are given when a batch is stored (`numbered`): a later batch has greater ids, which is the order of merging.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from weftline.functions import text as texts
from weftline.operators.running import running_sums
from weftline.sources.stage import staged


def ref(kind: str, key: Column) -> Column:
    return F.concat(F.lit(kind + ":"), key)


def attrs(**columns: Column) -> Column:
    """A map of JSON values; null columns stay as null values."""
    return F.map_from_arrays(F.array(*[F.lit(k) for k in columns]), F.array(*[F.regexp_extract(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}), r'(?s)^\{"x":(.*)\}$', 1) for c in columns.values()]))


def entity(df: DataFrame, kind: str, key: Column, name: Column, values: Column) -> DataFrame:
    return df.select(ref(kind, key).alias("key"), F.lit(kind).alias("type"), name.alias("name"), values.alias("attrs")).filter("key is not null")


def edge(df: DataFrame, kind: str, src: Column, dst: Column, time: Column, values: Column | None = None) -> DataFrame:
    none = F.create_map().cast("map<string,string>")
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), time.alias("time"), (none if values is None else values).alias("attrs")).filter("src is not null and dst is not null")


def unions(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


class Ingested(NamedTuple):
    entities: DataFrame
    observations: DataFrame
    conflicts: DataFrame


def merged(rows: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """One row a key, with the greatest non-empty value of each attribute, and the conflicts (key, attr, n): attributes
    for which a key has several such values. A null never overwrites. strict: a conflict raises where rows are read."""
    # A key begins with its type: as a column of the grouping, a filter of types reaches the sources. One pass for names and values.
    pairs = rows.select("key", "type", "name", F.explode_outer("attrs").alias("attr", "value"))
    full = F.when(~F.col("value").isin("null", '""', "0", "false", "[]"), F.col("value"))
    kept = pairs.groupBy("key", "type", "attr").agg(F.min("name").alias("name"), F.coalesce(F.max(full), F.max("value")).alias("value"), F.count_distinct(full).alias("n"))
    value = F.col("value")
    if strict:
        value = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("conflicting values: "), "key", F.lit(" "), "attr")).cast("string")).otherwise(value)
    listed = F.collect_list(F.when(F.col("attr").isNotNull(), F.struct("attr", value.alias("value"))))
    whole = kept.groupBy("key", "type").agg(F.min("name").alias("name"), F.map_from_entries(listed).alias("attrs"))
    return whole, kept.filter("n > 1").select("key", "attr", "n")


def ingested(rows: DataFrame, edges: DataFrame, strict: bool) -> Ingested:
    entities, conflicts = merged(rows, strict)
    return Ingested(entities, edges, conflicts)


def numbered(entities: DataFrame, observations: DataFrame, batch_id: int, base: int) -> tuple[DataFrame, DataFrame]:
    """Rows of a batch with ids from base on: entities by key, observations by all they hold. Ids come from a sort over
    ranges and each range's offset, so no task sees more than its range."""
    e = with_ids(entities, ["key"], base).select("id", F.lit(batch_id).cast("long").alias("batch_id"), "name", "type", "attrs", "key")
    to = e.select("key", "id")
    o = observations.join(to.withColumnsRenamed({"key": "src", "id": "src_id"}), "src").join(to.withColumnsRenamed({"key": "dst", "id": "dst_id"}), "dst")
    top = base + entities.count()
    o = with_ids(o, ["type", "time", "src_id", "dst_id"], top).select("id", F.lit(batch_id).cast("long").alias("batch_id"), "type", "time", "src_id", "dst_id", "attrs")
    return e.drop("key"), o


def with_ids(df: DataFrame, keys: list[str], base: int) -> DataFrame:
    """df with `id`: base, base + 1, ... in the order of the keys."""
    return running_sums(df, keys, {"id": F.lit(1)}).withColumn("id", (F.col("id") + base).cast("long"))


def git(commits: DataFrame, strict: bool = False) -> Ingested:
    """commits: (sha, author struct<name, email>, authored, committer struct<name, email>, committed, message,
    files array<struct<path, insertions, deletions, lines>>). A sha counts once; commits are keyed by its first ten digits."""
    c = commits.dropDuplicates(["sha"]).withColumn("key", F.substring("sha", 1, 10))
    who = lambda p: F.format_string("%s <%s>", f"{p}.name", f"{p}.email")
    persons = unions(*[entity(c, "person", who(p), who(p), attrs(name=F.col(f"{p}.name"), email=F.col(f"{p}.email"))) for p in ("author", "committer")])
    made = entity(c, "git_commit", F.col("key"), F.col("key"), attrs(commit_sha=F.col("sha"), message=F.col("message"), time=F.unix_seconds(F.col("committed").cast("timestamp"))))
    touched = c.select("key", "authored", F.explode("files").alias("f"))
    files = entity(touched, "file", F.col("f.path"), F.col("f.path"), F.create_map().cast("map<string,string>"))
    commit = ref("git_commit", F.col("key"))
    edges = unions(
        edge(c, "created", ref("person", who("author")), commit, F.col("authored")), edge(c, "committed", ref("person", who("committer")), commit, F.col("committed")),
        edge(touched, "modified", commit, ref("file", F.col("f.path")), F.col("authored"), attrs(insertions=F.col("f.insertions"), deletions=F.col("f.deletions"), lines=F.col("f.lines"))),
    )
    return ingested(unions(persons, made, files), edges, strict)


def mail(messages: DataFrame, strict: bool = False) -> Ingested:
    """messages: from_/to_/cc_ (name, email), subject, body_text, date, raw_date_string, message_id, refs array<struct<ref>>,
    flagged_abuse, filename. Rows without a raw date are left out; ends without a name give no edge; a reference to a
    message that is not there makes a placeholder."""
    m = messages.filter("raw_date_string is not null").withColumn("at", texts.resolve_date(F.col("date"), F.col("raw_date_string")))
    who = lambda p: F.when(F.col(f"{p}_name").isNotNull(), F.format_string("%s <%s>", f"{p}_name", f"{p}_email"))
    persons = unions(*[entity(m.filter(F.col(f"{p}_name").isNotNull()), "person", who(p), who(p), attrs(name=F.col(f"{p}_name"), email=F.col(f"{p}_email"))) for p in ("from", "to", "cc")])
    key = F.col("message_id")
    own = entity(m, "message", key, F.concat(F.lit("Message "), key), attrs(origin_filename=F.col("filename"), subject=texts.without_nul(F.col("subject")), body_text=texts.without_nul(F.col("body_text")), flagged_abuse=F.col("flagged_abuse"), time=F.unix_seconds("at")))
    cited = m.select("message_id", "at", F.explode("refs").alias("r")).filter("r.ref is not null")
    place = entity(cited, "message", F.col("r.ref"), F.concat(F.lit("Message "), F.col("r.ref")), F.create_map().cast("map<string,string>"))
    this = ref("message", key)
    edges = unions(
        edge(m, "message_from", ref("person", who("from")), this, F.col("at")), edge(m, "message_to", this, ref("person", who("to")), F.col("at")),
        edge(m, "message_cc", this, ref("person", who("cc")), F.col("at")), edge(cited, "message_ref", this, ref("message", F.col("r.ref")), F.col("at")),
    )
    return ingested(unions(persons, own, place), edges, strict)


def _login(p: str) -> Column:
    return F.col(f"{p}.login")


def github_person(p: str) -> Column:
    """The present parts of an author: name, <e-mail>, <GH account>; null if none is."""
    part = lambda form, c: F.when(F.coalesce(c, F.lit("")) != "", F.format_string(form, c))
    joined = F.concat_ws(" ", part("%s", F.col(f"{p}.name")), part("<%s>", F.col(f"{p}.email")), part("<GH %s>", _login(p)))
    return F.when(joined != "", joined)


def author_of(column: Column, kind: DataType) -> Column:
    """struct<name, email, login> of an author in either shape: its login may stand in it or in its user."""
    found = {f.name: f.dataType for f in kind.fields}
    text = lambda name: column[name] if name in found else F.lit(None).cast("string")
    logins = [F.when(text("login") != "", text("login"))]
    if isinstance(found.get("user"), StructType) and "login" in found["user"].names:
        logins.append(column["user"]["login"])
    return F.when(column.isNotNull(), F.struct(text("name").alias("name"), text("email").alias("email"), F.coalesce(*logins).alias("login")))


def with_authors(column: Column, kind: DataType, names: tuple[str, ...] = ("author", "committer")) -> Column:
    """A value of any nesting with its authors as `author_of` gives them."""
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: with_authors(x, kind.elementType, names))
    if not isinstance(kind, StructType):
        return column
    fields = [(author_of(column[f.name], f.dataType) if f.name in names and isinstance(f.dataType, StructType) else with_authors(column[f.name], f.dataType, names)).alias(f.name) for f in kind.fields]
    return F.when(column.isNotNull(), F.struct(*fields))


def with_either_shape(prs: DataFrame) -> DataFrame:
    """Requests whose authors, commits, comments and reviews all have authors of one shape; commits get `at`, the date of
    their author, and an author and a committer, null where the source has none."""
    kinds = {f.name: f.dataType for f in prs.schema.fields}
    commit = {f.name: f.dataType for f in kinds["commits"].elementType.fields}
    dated = isinstance(commit.get("author"), StructType) and "date" in commit["author"].names
    nobody = F.lit(None).cast("struct<name:string,email:string,login:string>")

    def one(c: Column) -> Column:
        at = F.to_timestamp(c["author"]["date"]) if dated else F.lit(None).cast("timestamp")
        people = [(author_of(c[p], commit[p]) if p in commit else nobody).alias(p) for p in ("author", "committer")]
        return F.struct(c["oid"].alias("oid"), at.alias("at"), *people)

    whole = prs.withColumns({n: with_authors(F.col(n), kinds[n]) for n in ("comments", "reviews")} | {"author": author_of(F.col("author"), kinds["author"])})
    return whole.withColumn("commits", F.transform("commits", one))


def pull_requests(prs: DataFrame, repo: str, strict: bool = False) -> Ingested:
    """prs: (number, bodyText, publishedAt, author, mergeCommit struct<oid>, commits array<struct<oid[, author, committer]>>,
    comments array<struct<author, bodyText, publishedAt>>, reviews array<struct<id, author, bodyText, publishedAt, comments>>).
    Authors are struct<name, email, login> or have the login in a struct `user`; any part may be missing. Those of commits
    (who are named there with their account) become persons without edges; a commit is attached at its author's date."""
    prs = with_either_shape(prs)
    pr = ref("github_pullrequest", F.concat(F.lit(f"{repo} PR "), F.col("number")))
    p = prs.withColumn("pr", pr)
    message = lambda who, body: F.format_string("Message <%s> hash %s", F.coalesce(who, F.lit("")), F.sha2(F.coalesce(body, F.lit("")), 256))
    review_key = F.concat(F.lit(f"{repo} "), F.col("r.id"))
    commits = p.select("pr", "publishedAt", F.explode("commits").alias("c"))
    comments = p.select("pr", F.explode("comments").alias("m")).withColumn("key", message(github_person("m.author"), F.col("m.bodyText")))
    reviews = p.select("pr", F.explode("reviews").alias("r"))
    replies = reviews.select("r", F.explode("r.comments").alias("m")).withColumn("key", message(github_person("m.author"), F.col("m.bodyText")))
    # Each author once before its values are written as JSON, since many commits have one.
    own = attrs(name=F.col("who.name"), email=F.col("who.email"), github_user=_login("who"))
    person = lambda df, q: entity(df.select(F.col(q).alias("who")).distinct(), "person", github_person("who"), github_person("who"), own)
    rows = unions(
        person(p, "author"), person(commits, "c.author"), person(commits, "c.committer"), person(comments, "m.author"), person(reviews, "r.author"), person(replies, "m.author"),
        entity(p, "github_pullrequest", F.concat(F.lit(f"{repo} PR "), F.col("number")), F.concat(F.lit(f"{repo} PR "), F.col("number")), attrs(github_pr_number=F.col("number"), body_text=F.col("bodyText"), created=F.unix_seconds(F.col("publishedAt").cast("timestamp")))),
        entity(commits.select("c.oid").distinct(), "git_commit", F.col("oid"), F.col("oid"), attrs(commit_sha=F.col("oid"))), entity(p.filter("mergeCommit is not null"), "git_commit", F.col("mergeCommit.oid"), F.col("mergeCommit.oid"), attrs(commit_sha=F.col("mergeCommit.oid"))),
        entity(reviews, "github_review", review_key, review_key, attrs(id=F.col("r.id"), body_text=F.col("r.bodyText"))),
        entity(comments, "message", F.col("key"), F.col("key"), attrs(body_text=F.col("m.bodyText"))), entity(replies, "message", F.col("key"), F.col("key"), attrs(body_text=F.col("m.bodyText"))),
    )
    at = lambda q: F.col(f"{q}.publishedAt")
    by = lambda q: ref("person", github_person(q))
    msg, review = ref("message", F.col("key")), ref("github_review", review_key)
    edges = unions(
        edge(p, "created", by("author"), F.col("pr"), F.col("publishedAt")), edge(p, "merged_as", F.col("pr"), ref("git_commit", F.col("mergeCommit.oid")), F.col("publishedAt")),
        edge(commits, "attached_to", ref("git_commit", F.col("c.oid")), F.col("pr"), F.coalesce(F.col("c.at").cast(prs.schema["publishedAt"].dataType), F.col("publishedAt"))), edge(comments, "message_to", msg, F.col("pr"), at("m")), edge(comments, "message_from", by("m.author"), msg, at("m")),
        edge(reviews, "attached_to", review, F.col("pr"), at("r")), edge(reviews, "created", by("r.author"), review, at("r")), edge(replies, "message_to", msg, review, at("m")), edge(replies, "message_from", by("m.author"), msg, at("m")),
    )
    return ingested(rows, edges, strict)


#: First names in the author index that stand for a key of their own, with the name that stays.
SPECIAL_AUTHORS = {"Guido (GvR)": ("GvR", "Guido"), "Just (JvR)": ("JvR", "Just")}


def header_fields(text: Column) -> Column:
    """array<struct<name, value>> of the block of fields at the start of a text, up to its first blank line. Lines that begin with
    a blank go on with the field before; lines without a colon are left out."""
    block = F.regexp_extract(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), r"(?s)\A\n*(.*?)(?:\n[ \t]*\n|\z)", 1)
    lines = F.filter(F.split(F.regexp_replace(block, r"\n[ \t]+", " "), "\n"), lambda x: x.contains(":"))
    return F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.regexp_replace(F.substring(x, F.instr(x, ":") + 1, F.length(x)), r"^\s+|\s+$", "").alias("value")))


def header_value(fields: Column, start: str) -> Column:
    """Value of the last field whose name begins so, "" if there is none."""
    found = F.filter(fields, lambda x: x["name"].startswith(start))
    return F.when(F.size(found) > 0, F.element_at(found, -1)["value"]).otherwise("")


def author_index(authors: DataFrame) -> DataFrame:
    """(key, named): how the index names an author, and "first last suffix <email>". authors: (place, name "Last, First, Suffix",
    email with " at "); of equal keys the last place counts."""
    part = lambda k: F.coalesce(F.get(F.split("name", ", "), F.lit(k)), F.lit(""))
    key, first = part(0), part(1)
    for written, (own, name) in SPECIAL_AUTHORS.items():
        key, first = F.when(part(1) == written, own).otherwise(key), F.when(part(1) == written, name).otherwise(first)
    email = F.when(F.trim(F.regexp_replace(F.coalesce("email", F.lit("")), "\u00a0", " ")) == "", "").otherwise(F.replace("email", F.lit(" at "), F.lit("@")))
    rows = authors.select("place", key.alias("key"), F.concat(first, F.lit(" "), part(0), F.lit(" "), part(2), F.lit(" <"), email, F.lit(">")).alias("named"))
    return rows.groupBy("key").agg(F.max_by("named", "place").alias("named"))


def proposal_records(index: DataFrame, pages: DataFrame, authors: DataFrame) -> DataFrame:
    """What `proposals` reads, from an index, the proposals' own texts and the author index.

    index: (number, url, title, authors: keys with ", " between), pages: (number, text), authors as in `author_index`. Keys that
    the author index lacks are left out; a number without a text has empty fields.
    """
    keys = index.select("number", F.posexplode(F.split(F.coalesce("authors", F.lit("")), ", ")).alias("at", "key"))
    named = keys.join(staged(author_index(authors), "author-index"), "key").groupBy("number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "named"))), lambda x: x["named"]), "; ").alias("authors"))
    fields = pages.select("number", header_fields(F.col("text")).alias("f"))
    names = {"type": "Type", "status": "Status", "created": "Created", "replaces": "Replaces", "superseded_by": "Superseded", "requires": "Requires"}
    own = fields.select("number", *[header_value(F.col("f"), start).alias(c) for c, start in names.items()])
    rows = index.select("number", "url", "title").join(named, "number", "left").join(own, "number", "left")
    tidy = F.replace(F.trim(F.coalesce("authors", F.lit(""))), F.lit("  "), F.lit(" "))
    return rows.select("number", "url", *[F.coalesce(c, F.lit("")).alias(c) for c in ("type", "status")], "title", tidy.alias("authors"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("created", "replaces", "superseded_by", "requires")])


def proposals(peps: DataFrame, strict: bool = False) -> Ingested:
    """peps: (number, url, type, status, title, authors "Name <mail>; ...", created "dd-MMM-yyyy", replaces, superseded_by,
    requires: numbers with blanks between)."""
    p = peps.withColumn("at", F.to_timestamp("created", "dd-MMM-yyyy"))
    listed = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), " +"), lambda x: x != "")
    authors = p.select("number", "at", F.explode(F.split("authors", "; ")).alias("a")).filter("a <> ''")
    name, mail_ = F.regexp_extract("a", "^(.*) <(.*)>$", 1), F.regexp_extract("a", "^(.*) <(.*)>$", 2)
    pep = lambda c: ref("pep", c.cast("string"))
    rows = unions(
        entity(authors, "person", F.col("a"), F.col("a"), attrs(name=F.when(name != "", name).otherwise(F.col("a")), email=F.when(mail_ != "", mail_))),
        entity(p, "pep", F.col("number").cast("string"), F.concat(F.lit("PEP "), F.col("number")), attrs(number=F.col("number"), url=F.col("url"), type=F.col("type"), status=F.col("status"), title=F.col("title"), created=F.unix_seconds("at"), replaces=listed("replaces"), superseded_by=listed("superseded_by"), requires=listed("requires"))),
    )
    # "old is superseded by new" can stand on either side; the time is the new one's creation.
    old = unions(p.select(F.explode(listed("replaces")).alias("old"), F.col("number").cast("string").alias("new")), p.select(F.col("number").cast("string").alias("old"), F.explode(listed("superseded_by")).alias("new"))).distinct()
    over = old.join(p.select(F.col("number").cast("string").alias("new"), "at"), "new")
    needs = p.select("number", "at", F.explode(listed("requires")).alias("other"))
    edges = unions(
        edge(authors, "created", ref("person", F.col("a")), pep(F.col("number")), F.col("at")), edge(over, "superseded_by", pep(F.col("old")), pep(F.col("new")), F.col("at")), edge(needs, "requires", pep(F.col("number")), pep(F.col("other")), F.col("at"))
    )
    return ingested(rows, edges, strict)


def breaches(persons: DataFrame, lookup: DataFrame, stat: str = "breaches") -> DataFrame:
    """(name, email, n): a new person for every distinct address with an @; 0 where the lookup has none."""
    mails = persons.select("email").filter(F.col("email").contains("@")).distinct()
    found = mails.join(lookup.select("email", F.col(stat).cast("long").alias("n")), "email", "left")
    return found.select(F.format_string(f"HIBP {stat} <%s>", "email").alias("name"), "email", F.coalesce("n", F.lit(0)).alias("n"))


def link_text_refs(items: DataFrame, targets: DataFrame, pattern: str = r"pep (\d+)(?=\D)", fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """(src_id, dst_id, field, time): an edge for each field that names a target. items: (id, time, fields...), targets:
    (id, number). Numbers meet as strings, so "008" is not 8; a name at the very end of a text does not count."""
    found = None
    for f in fields:
        rows = items.select("id", "time", F.lit(f).alias("field"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(f), F.lit(pattern), F.lit(1)))).alias("number"))
        found = rows if found is None else found.unionByName(rows)
    to = targets.select(F.col("id").alias("dst_id"), F.col("number").cast("string").alias("number"))
    return found.join(to, "number").select(F.col("id").alias("src_id"), "dst_id", "field", "time")


def collaborator_overlay(members: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(person), (src, dst, project, time): persons with `least` projects or more, and an edge between any two of them in a
    project. members: (person, project, time). Pairs stay within a project, whose members are few by nature; a project's
    rows are sorted out by AQE if not."""
    distinct = members.groupBy("person", "project").agg(F.min("time").alias("time"))
    busy = distinct.groupBy("person").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("person")
    kept = distinct.join(busy, "person", "left_semi")
    pairs = kept.join(kept.select(F.col("person").alias("dst"), "project"), "project").filter("person <> dst")
    return busy, pairs.select(F.col("person").alias("src"), "dst", "project", "time")

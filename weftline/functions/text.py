"""Columns for message texts: parts of a mail, terms, words, dates, statuses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values
HEADER = r"(?i)^(On .*,.*wrote|Le [a-z]+\..*crit ):$"
ATTRIBUTION = r"(?i)(schrieb|wrote):$"
CLOSING = r"(?i)^(best|best wishes|cheers|regards|thank you|thanks|--),?$"
#: Terms that lists may contain and that count as harmless.
HARMLESS = "alla are asian backdoor bigger black colored destroy failure guido harder insertions native primitive".split()
STATUSES = {"good": ["active", "accepted", "final", "superseded"], "bad": ["withdrawn", "rejected", "deferred", "april fool!"], "other": ["draft", "provisional"]}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_message(text: Column) -> Column:
    """struct(body, quote, sign) of a mail. A line is a header that names the quoted author (left out), a quote (">"), or
    body; from the first closing line on, it is signature instead of body. "X wrote:" is a header too while there is no
    body line yet. Blank lines count as body. Whole-array functions; no state runs from line to line: a line's part
    follows from its own marks, the first closing line and the first body line.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip)
    marked = F.transform(
        lines,
        lambda x, i: F.struct(
            x.alias("text"), i.alias("at"), F.regexp_replace(x, "^(> ?)+", "").rlike(HEADER).alias("header"), x.rlike(ATTRIBUTION).alias("attribution"), x.startswith(">").alias("quote"), x.rlike(CLOSING).alias("closing")
        ),
    )
    far = F.lit(2**31 - 1)
    at = lambda m: m["at"]
    close = lambda marked: F.coalesce(F.array_min(F.transform(F.filter(marked, lambda m: m["closing"] & ~m["header"] & ~m["quote"]), at)), far)
    start = lambda marked, end: F.coalesce(F.array_min(F.transform(F.filter(marked, lambda m: ~m["header"] & ~m["quote"] & ~m["attribution"] & (m["at"] < end)), at)), far)

    def parts(kept: Column, end: Column) -> Column:
        part = lambda keep: strip(F.array_join(F.transform(F.filter(kept, keep), lambda m: m["text"]), "\n"))
        return F.struct(part(lambda m: ~m["quote"] & (m["at"] < end)).alias("body"), part(lambda m: m["quote"]).alias("quote"), part(lambda m: ~m["quote"] & (m["at"] >= end)).alias("sign"))

    kept = lambda marked, first: F.filter(marked, lambda m: ~m["header"] & ~(m["attribution"] & (m["at"] < first)))
    return once(marked, lambda m: once(close(m), lambda end: once(start(m, end), lambda first: once(kept(m, first), lambda k: parts(k, end)))))


def once(value: Column, use) -> Column:
    """use(value), with the value made once a row: what stands inside of a lambda is else made anew for each element."""
    return F.transform(F.array(value), use)[0]


def message_text(subject: Column, body: Column) -> Column:
    return F.concat(F.coalesce(subject, F.lit("")), F.lit(" !!! "), F.coalesce(body, F.lit("")))


def term_pattern(terms, harmless=HARMLESS) -> str:
    """Terms as whole words, the longest first, whatever their case."""
    kept = sorted({t.strip().lower() for t in terms if t.strip()} - set(harmless), key=lambda t: (-len(t), t))
    return r"(?i)\b(?:" + "|".join(re.escape(t) for t in kept) + r")\b"


def term_count(c: Column, terms) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(term_pattern(terms))).cast("long")


def term_examples(c: Column, terms) -> Column:
    """The distinct terms found, in lower case, sorted."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(term_pattern(terms)), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"(?U)\w+")).cast("long")


def without_nul(c: Column) -> Column:
    return F.replace(c, F.lit("\x00"), F.lit("<NULL>"))


def resolve_date(*candidates: Column) -> Column:
    """The first candidate that reads as a time: ISO, or "Thu, 23 May 2002 23.19.24 +0200"; an error if none does."""
    found = []
    for c in candidates:
        plain = F.regexp_replace(c, r"^\s*[A-Za-z]{3},\s*", "")
        found += [F.try_to_timestamp(c), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH.mm.ss Z")), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z"))]
    shown = F.concat_ws(" | ", *candidates)
    return F.coalesce(*found, F.raise_error(F.concat(F.lit("no date in: "), shown)).cast("timestamp"))


def status_class(c: Column) -> Column:
    """good, bad, other or unknown, by what the status begins with."""
    low = F.lower(c)
    out = F.lit("unknown")
    for name, words in reversed(STATUSES.items()):
        out = F.when(low.rlike("^(" + "|".join(map(re.escape, words)) + ")"), name).otherwise(out)
    return out


def type_class(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.startswith("standards"), "S").when(low.startswith("process"), "P").when(low.startswith("information"), "I")


def short_remote(url: Column) -> Column:
    """"host/path" of a repository's address; an error for other forms."""
    ssh = F.regexp_extract(url, r"^git@([^:]+):(.+)$", 0) != ""
    return F.when(ssh, F.regexp_replace(url, r"^git@([^:]+):(.+)$", "$1/$2")).when(url.startswith("https://"), F.regexp_replace(url, "^https://", "")).otherwise(F.raise_error(F.concat(F.lit("not a remote: "), url)).cast("string"))


def terms_by_part(text: Column, lists: dict[str, list[str]]) -> Column:
    """Array of (part, list, n) for the parts of a mail and the lists of which it has a term."""
    parts = split_message(text)
    rows = [F.struct(F.lit(p).alias("part"), F.lit(k).alias("list"), term_count(parts[p], v).alias("n")) for p in ("body", "quote", "sign") for k, v in lists.items()]
    return F.filter(F.array(*rows), lambda r: r["n"] > 0)

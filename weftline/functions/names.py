"""Columns for names and addresses: cleaning, validity, phonetic keys, trigrams."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values
TITLES = ["mrs. ", "mr. ", "ms. ", "dr. "]
COMPANY_SUFFIXES = ["inc", "co. ltd", "co. limited", "co ltd", "co limited", "pvt. ltd", "pvt. limited", "pvt ltd", "pvt limited", "private ltd", "private limited", "ltd", "limited", "gmbh"]
FAMILY_TERMS = [" family members.", " family members", " family.", " family"]
LETTERS = {"ð": "d", "ł": "l"}
#: Domains of which any ending is invalid, domains that are invalid as they stand, invalid names before the @, and addresses.
INVALID_DOMAINS = "bar blah does.not.exist domain email example here invalid non none nospam nowhere null spam someplace test".split()
INVALID_SITES = "bla.com mail.com me.com".split()
INVALID_BOXES = "fake nobody noreply no-reply nospam no-spam".split()
INVALID_ADDRESSES = (
    "a@bc.de aa@bb.cc asdf@asdf.com docs@python.org john@doe.com john@smith.com mail.python.org@marco.sulla.e4ward.com me@privacy.net python-url@phaseit.net "
    "python@python.org python-dev@python.org python-help@python.org python-list@python.org support@superhost.gr user@compgroups.net/"
).split()


def any_of(words) -> str:
    return "|".join(re.escape(w) for w in words)


#: RE2-safe, so that SQL engines without look-around read it alike: two @; a last or only label of one character before
#: an optional ending; the lists above.
INVALID_EMAIL = rf"@.*@|@(.*\.)*.(\.[^.]*)?$|@({any_of(INVALID_DOMAINS)})(\.[^.]*)?$|@({any_of(INVALID_SITES)})|^({any_of(INVALID_BOXES)})@|{any_of(INVALID_ADDRESSES)}"


def valid_email(c: Column) -> Column:
    """Whether an address names a person's mailbox; false for null and empty."""
    return F.coalesce((c != "") & ~c.rlike(INVALID_EMAIL), F.lit(False))


@F.pandas_udf(StringType())
def fold(names: pd.Series) -> pd.Series:
    """Letters without their marks; what has no ASCII form goes."""

    def one(s):
        if s is None or s.isascii():
            return s
        return unicodedata.normalize("NFKD", "".join(LETTERS.get(x, x) for x in s)).encode("ascii", "ignore").decode()

    return names.map(one, na_action="ignore")


def spread_initials(c: Column) -> Column:
    """"A.B.C" to "A B C", where the capital stands alone."""
    return F.replace(F.regexp_replace(c, r"(?<![A-Z])([A-Z])\.", "$1 "), F.lit("  "), F.lit(" "))


def strip_titles(c: Column) -> Column:
    c = F.regexp_replace(c, r"^(?:reverend |rev\. )", "")
    for t in TITLES:
        c = F.regexp_replace(c, "^" + re.escape(t), "")
    return c


def junior(c: Column) -> Column:
    return F.when(c.endswith(", jr."), F.replace(c, F.lit(", jr."), F.lit(" jr"))).when(c.endswith("jr."), F.regexp_replace(c, r"\.$", "")).otherwise(c)


def saint(c: Column) -> Column:
    return F.regexp_replace(c, r"^st\. ", "st ")


def strip_company(c: Column) -> Column:
    """Suffixes in list order, so that several can go."""
    for s in COMPANY_SUFFIXES:
        c = F.regexp_replace(c, r",? " + re.escape(s) + r"\.?$", "")
    return c


def strip_family(c: Column) -> Column:
    for t in FAMILY_TERMS:
        c = F.regexp_replace(c, re.escape(t) + "$", "")
    return c


def clean_name(c: Column, ascii_only: bool = False) -> Column:
    """The comparable form of a name. ascii_only: the names are known to be ASCII, so nothing leaves the JVM."""
    c = F.lower(spread_initials(c if ascii_only else fold(c)))
    c = F.translate(c, '()"', "")
    return F.trim(F.replace(strip_family(strip_company(saint(junior(strip_titles(c))))), F.lit(" & "), F.lit(" and ")))


def without_brackets(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, r"\(.*?\)", ""), F.lit("  "), F.lit(" "))


def without_quoted(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, r'".*?"', ""), F.lit("  "), F.lit(" "))


def without_middle_names(c: Column) -> Column:
    return F.regexp_replace(c, " .* ", " ")


def family_last(c: Column, separators: tuple[str, ...] = (" - ", ", ")) -> Column:
    """"Family - First" and "Family, First" as "First Family"; only where there are two parts."""
    for s in separators:
        parts = F.split(c, re.escape(s))
        c = F.when(F.size(parts) == 2, F.concat(F.get(parts, 1), F.lit(" "), F.get(parts, 0))).otherwise(c)
    return c


def names_of_item(c: Column) -> Column:
    """An item's names: up to the first of ",;:", cut at " and "; of two, the first gets the last words of the second
    from its own length on, unless the second begins with "his" or "her"."""
    clauses = F.split(F.regexp_replace(c, r"(?s)[,;:].*", ""), " and ")
    head, tail = F.get(clauses, 0), F.get(clauses, 1)
    first, second = F.split(head, " "), F.split(tail, " ")
    whole = F.concat_ws(" ", head, F.when(F.size(second) > F.size(first), F.array_join(F.slice(second, F.size(first) + 1, F.greatest(F.size(second) - F.size(first), F.lit(0))), " ")))
    return F.when((F.size(clauses) == 2) & ~tail.rlike("^(his|her)"), F.array(whole, tail)).otherwise(clauses)


def trigrams(c: Column) -> Column:
    """The distinct trigrams of the lower-cased words, each with two blanks before and one behind."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)[\p{L}\p{N}]+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 without any."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


VOWELS, SOFT = frozenset("AEIOU"), frozenset("EIY")
#: The public Metaphone rules (fixed values): letters that start a word silently, letters that sound as they are written or
#: as another one, and letters before an H that take its sound.
SILENT_STARTS, PLAIN, NO_H = ("AE", "GN", "KN", "PN", "WR"), {**{c: c for c in "FJLMNR"}, "Q": "K", "V": "F", "X": "KS", "Z": "S"}, frozenset("CGPST")


def metaphone(word: str, length: int = 20) -> str:
    """A word's sound in consonants; each letter is judged by its neighbours, from left to right."""
    w = re.sub("[^A-Z]", "", word.upper())
    at = lambda k: w[k] if 0 <= k < len(w) else ""
    out, k = [], 0
    if w.startswith(SILENT_STARTS):
        out, k = [w[1]], 2
    elif w[:1] == "X" or w[:2] == "WH" or w[:1] in VOWELS:
        out, k = ["S" if w[:1] == "X" else w[:1]], 2 if w[:2] == "WH" else 1
    while k < len(w):
        c, before, after, third = w[k], at(k - 1), at(k + 1), at(k + 2)
        sound, step = "", 1
        if c == before and c != "C":
            pass
        elif c in PLAIN:
            sound = PLAIN[c]
        elif c == "B":
            sound = "" if before == "M" else "B"
        elif c == "C":
            if after in SOFT:
                sound = "X" if after == "I" and third == "A" else "" if before == "S" else "S"
            elif after == "H":
                sound, step = "K" if third == "R" or before == "S" else "X", 2
            else:
                sound = "K"
        elif c == "D":
            sound, step = ("J", 2) if after == "G" and third in SOFT else ("T", 1)
        elif c == "G":
            if after == "H":
                # As in "laugh", unless an earlier letter makes it silent, as in "bough" and "height".
                sound, step = ("", 1) if at(k - 3) in frozenset("BDH") or at(k - 4) == "H" else ("F", 2)
            elif after == "N":
                sound = "" if not third or third == "E" and at(k + 3) == "D" else "K"
            else:
                sound = "J" if after in SOFT and before != "G" else "K"
        elif c == "H":
            sound = "H" if after in VOWELS and before not in NO_H else ""
        elif c == "K":
            sound = "" if before == "C" else "K"
        elif c == "P":
            sound = "F" if after == "H" else "P"
        elif c == "S":
            if after == "I" and third in ("O", "A"):
                sound = "X"
            elif after == "H":
                sound, step = "X", 2
            elif after == "C" and third == "H":
                sound, step = "SK", 3
            else:
                sound = "S"
        elif c == "T":
            if after == "I" and third in ("O", "A"):
                sound = "X"
            elif after == "H":
                sound, step = "0", 2
            elif not (after == "C" and third == "H"):
                sound = "T"
        elif c in "WY":
            sound = c if after in VOWELS else ""
        out.append(sound)
        k += step
    return "".join(out)[:length]


@F.pandas_udf(StringType())
def phonetic_key(names: pd.Series) -> pd.Series:
    """The sounds of a name's parts, with blanks between; null for null."""
    known: dict[str, str] = {}

    def one(s):
        return " ".join(known[p] if p in known else known.setdefault(p, metaphone(p)) for p in s.split(" "))

    return names.map(one, na_action="ignore")

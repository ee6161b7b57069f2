"""Licence scan: Aho-Corasick finds notice phrases and identifier tags; a shunting-yard parser evaluates
the and/or/with expressions behind the tags.

Phrases are sequences of words and are found wherever their words stand one after another, whatever stands
between the words. Tags ("SPDX-License-Identifier:") are followed by an expression up to the line's end or the next tag.

Operands are licence ids: of a known family (FREEDOM, OTHER_FAMILIES) or a LicenseRef. Any other operand is unknown: it adds
no label and leaves the value to the operand beside it; an expression of unknown operands alone does not count.

Defined cases: a null or empty text has no words, no places, null first_word and last_word, empty labels and
score 0; very long texts are scanned whole, in time linear in their length; repeated rows are scanned each; an expression that does not parse adds no
label and counts as none; an empty table gives an empty table; other columns are left out, whatever their names.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from .common import map_rows, table

#: Base phrases and labels (fixed values of the contract).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "bsd license": "bsd", "isc license": "isc", "boost software license": "boost", "creative commons attribution": "cc-by", "cc0": "cc0", "public domain": "public-domain",
    "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution non commercial": "cc-by-nc", "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noderivs": "cc-by-nd", "creative commons attribution no derivatives": "cc-by-nd", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution share alike": "cc-by-sa",
    "attribution noncommercial": "cc-by-nc", "attribution non commercial": "cc-by-nc", "attribution noderivatives": "cc-by-nd", "attribution noderivs": "cc-by-nd", "attribution no derivatives": "cc-by-nd",
    "attribution sharealike": "cc-by-sa", "attribution share alike": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa", "cc by nc nd": "cc-by-nc-nd", "cc by nc sa": "cc-by-nc-sa",
    "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd", "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: How freely a licence lets text be used, 0 to 1; versions go with their family, others are unknown, 0.5.
FREEDOM = {
    "0bsd": 1.0, "agpl": 0.3, "all-rights-reserved": 0.0, "apache": 1.0, "artistic": 0.8, "boost": 1.0, "bsd": 1.0, "bsl": 1.0, "cc-by": 0.9, "cc-by-nc": 0.2, "cc-by-nd": 0.3, "cc-by-sa": 0.6, "cc0": 1.0, "cddl": 0.6, "epl": 0.7, "eupl": 0.5, "gfdl": 0.4, "gpl": 0.4, "isc": 1.0,
    "lgpl": 0.6, "mit": 1.0, "mpl": 0.7, "odbl": 0.5, "ofl": 0.9, "postgresql": 1.0, "psf": 1.0, "public-domain": 1.0, "python": 1.0, "unlicense": 1.0, "wtfpl": 1.0, "zlib": 1.0,
}
UNKNOWN = 0.5
#: First words of further public licence ids, whose freedom is unknown (fixed values).
OTHER_FAMILIES = frozenset(
    """aal abstyles adobe adsl afl afmparse aladdin amdplpa aml ampas antlr apafml apl app apsl arphic bahyph barr beerware bitstream bittorrent blessing
    blueoak borceux brian bzip2 c cal caldera catosl cc cdl cdla cecill cern clartistic cmu cnri coil condor copyleft cpal cpl cpol crossword crystalstacker cua cube curl d
    diffmark doc dotseqn drl dsdp dvipdfm ecl ecos efl egenix elastic entessa erlpl etalab eudatagrid fair frameworx freebsd freeimage fsfap fsful ftl gd giftware gl2ps glide glulxe gnuplot
    gsoap haskellreport hippocratic hpnd ibm icu ijg imagemagick imatix imlib2 info intel interbase ipa ipl jam jasper jpnic json lal latex2e leptonica libpng libtiff liliq linux lpl lppl lzma
    makeindex miros motosoto mpich2 ms mtll mulanpsl multics mup naist nasa naumen nbpl ncgl ncsa netcdf ngpl nlod nlpl nokia nosl noweb npl nposl ntp o oclc oda odc ogc ogl
    oldap openssl opl opubl oset osl parity php plexus polyform psutils qhull qpl rdisc rhecos rpl rpsl rsa ruby saxpath scea sendmail sgi shl sissl sleepycat smlnj snia spencer sspl
    ssh sugarcrm swl tapr tcl tcp tmate torque tosl ucl unicode upl vim vostrom vsl w3c watcom wsuipa x11 xerox xfree86 xinetd xnet xpp xskat ypl zed zend zimbra zpl""".split()
)

#: Bytes that separate words become blanks and A-Z lower case; all bytes of 128 and over belong to words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
RANK = {"or": 1, "and": 2, "with": 3}


def words_of(text: str | None) -> str:
    """The words, lower-cased, with one blank before, between and after them."""
    return (b" %s " % b" ".join((text or "").encode().translate(WORDS).split())).decode()


def automaton(keys: dict[str, object]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for key, value in keys.items():
        found.add_word(key, (len(key), value))
    found.make_automaton()
    return found


def postfix(expression: str) -> list[str] | None:
    """Shunting yard: the expression's operands and operators in evaluation order, or None if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = True
    for found in TOKEN.finditer(expression):
        token = found.group()
        low = token.lower()
        if low in RANK:
            if operand:
                return None
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if operand or not stack:
                return None
            stack.pop()
        elif operand:
            out.append(low)
            operand = False
        else:
            break  # prose after the expression
    while stack:
        if stack[-1] == "(":
            return None
        out.append(stack.pop())
    return None if operand else out


def freedom(name: str) -> float:
    """The freedom of an id, or of the longest family that it belongs to."""
    while name and name not in FREEDOM:
        name = name.rpartition("-")[0]
    return FREEDOM.get(name, UNKNOWN)


def is_licence(name: str) -> bool:
    family = name.split("-")[0]
    return name.startswith("licenseref-") or family in FREEDOM or family in OTHER_FAMILIES and (name == family and len(name) > 2 or "-" in name)


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Licence ids and freedom: `or` lets the reader choose (the freer), `and` binds to both (the stricter),
    `with` adds an exception, which is named too, to the licence on its left. None if no operand is a licence."""
    steps = postfix(expression)
    if steps is None:
        return None
    stack: list[tuple[set[str], float | None]] = []
    # What stands right of a `with` names an exception, whatever it is called.
    for at, step in enumerate(steps):
        if step not in RANK:
            name = step.rstrip(".:").removesuffix("+").removesuffix("-only").removesuffix("-or-later")
            if at + 1 < len(steps) and steps[at + 1] == "with":
                stack.append(({name}, None))
            else:
                stack.append(({name}, freedom(name)) if is_licence(name) else (set(), None))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if step == "with":
            stack.append((left | right, min(1.0, a + 0.1)) if a is not None else (left, a))
        elif a is None or b is None:
            stack.append((left, a) if b is None else (right, b))
        else:
            stack.append((left | right, max(a, b) if step == "or" else min(a, b)))
    labels, free = stack[0]
    return None if free is None else (labels, free)


def scanner(phrases: dict[str, str], base: dict[str, str]):
    """A function text -> (n_words, places of base phrases, their first and last word, base labels, all labels, score)."""
    search = automaton({f" {k} ": (k in base, v) for k, v in (phrases | base).items()})
    tags = automaton({k: k for k in TAGS})

    def scan(text: str | None):
        words = words_of(text)
        n = words.count(" ") - 1 if len(words) > 2 else 0
        starts, base_labels, labels, free = [], set(), set(), []
        for end, (length, (is_base, label)) in search.iter(words):
            labels.add(label)
            if is_base:
                starts.append(end - length + 1)
                base_labels.add(label)
        free = [freedom(x) for x in labels]
        low = (text or "").lower()
        at = [(end + 1, end + 1 - length) for end, (length, _) in tags.iter(low)] if ":" in low else []
        for (start, _), limit in zip(at, [*(begin for _, begin in at[1:]), len(low)], strict=False):
            stop = low.find("\n", start, limit)
            line = (text if len(low) == len(text) else low)[start : stop if stop >= 0 else limit]
            if (value := evaluate(line)) is not None:
                labels |= value[0]
                free.append(value[1])
        first, last = (words.count(" ", 0, min(starts)), words.count(" ", 0, max(starts))) if starts else (None, None)
        return n, len(starts), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), float(min(free)) if free else 0.0

    return scan


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score). score: how freely the strictest
    of the notices and expressions found lets the text be used; 0 without any."""

    def build():
        scan = scanner(notices, base)
        return lambda doc_id, text: (doc_id, *scan(text))

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", build)


def op3(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))

"""Columns on values with known results."""

import time

import pytest
from pyspark.sql import functions as F

from weftline.functions import names, numbers, text


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame(list(enumerate(inputs)), f"k int, x {kind}").orderBy("k")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


INVALID = (
    "a@a.com a@b.c a@bc.de aa@bb.cc bla@bla.com blah@blah.blah d@d.d docs@python.org email@domain.com fake@comcast.net false@email.com foo@bar.com invalid@email.com invalid@invalid.invalid j@b.com me@here.com me@me.com "
    "me@privacy.net no@email.com no@mail.com no@spam.com nobody@gmail.com nobody@nowhere.nohow non@non.com non@none.net none@example.com none@none noone@nowhere.com noreply@scour.com nospam@hotmail.com null@null.com "
    "python-dev@python.org someone@someplace.com spam@spam.org test@test.test x@x.com x@x.x a@b@c.org"
).split()


def test_valid_email(spark):
    assert values(spark, names.valid_email, ["hithere@gmail.com", None, "", *INVALID]) == [True, False, False] + [False] * len(INVALID)


@pytest.mark.parametrize(
    ("column", "pairs"),
    [
        (names.strip_titles, {"mrs. somebody": "somebody", "rev. dr. somebody": "somebody", "reverend somebody": "somebody"}),
        (names.junior, {"Aluizio Prata, jr.": "Aluizio Prata jr", "Aluizio Prata jr.": "Aluizio Prata jr", "Aluizio Prata jr": "Aluizio Prata jr"}),
        (names.saint, {"st. Clare": "st Clare", "st Clare": "st Clare"}),
        (names.strip_company, {"Acme, inc.": "Acme", "Acme inc.": "Acme", "Acme co. limited": "Acme", "Acme, private ltd.": "Acme", "Acme pvt. ltd": "Acme"}),
        (names.strip_family, {"Sarasola Marulanda family.": "Sarasola Marulanda", "Nakash family members": "Nakash"}),
        (names.spread_initials, {"A.Singh": "A Singh", "A. Singh": "A Singh", "A.B.C.Singh": "A B C Singh", "A.B.C. Singh": "A B C Singh", "ABC.Singh": "ABC.Singh", "Singh INC.": "Singh INC."}),
        (names.without_brackets, {"CEO (Lionel Messi) star": "CEO star", "(CEO) (Lionel) Messi star": " Messi star"}),
        (names.without_quoted, {'Maria "Imelda" Imee "Marcos" Manotoc': "Maria Imee Manotoc"}),
        (names.without_middle_names, {"Hamad bin Jassim bin Jaber Al Thani": "Hamad Thani", "K. P. Singh": "K. Singh", "Sean Mulryan": "Sean Mulryan"}),
        (names.fold, {"sigmundur davíð gunnlaugsson": "sigmundur david gunnlaugsson", "Çaðłayan": "Cadlayan"}),
        (names.family_last, {"Terrero - Santiago": "Santiago Terrero", "Terrill, Brendan Mark": "Brendan Mark Terrill", "Terrill Brendan Mark": "Terrill Brendan Mark"}),
        (names.clean_name, {'Dr. "Jörg" A.B.Smith & (Co), inc.': "jorg a b smith and co", None: None}),
    ],
)
def test_names(spark, column, pairs):
    assert values(spark, column, list(pairs)) == list(pairs.values())


def test_names_of_item(spark):
    got = values(spark, names.names_of_item, ["Rajiv Dey and his sister Priya Dey", "Priyanka Dey and her sisters Priya Dey and others", "Francisco and Juan Jose Franco Suelves", "Francisco Ramon and Juan Jose Franco Suelves", "Helene Mathieu; legal, consultant"])
    assert got == [["Rajiv Dey", "his sister Priya Dey"], ["Priyanka Dey", "her sisters Priya Dey", "others"], ["Francisco Jose Franco Suelves", "Juan Jose Franco Suelves"], ["Francisco Ramon Franco Suelves", "Juan Jose Franco Suelves"], ["Helene Mathieu"]]


def test_trigrams(spark):
    assert values(spark, names.trigrams, ["Cat"]) == [["  c", " ca", "cat", "at "]]
    row = spark.range(1).select(names.similarity(names.trigrams(F.lit("word")), names.trigrams(F.lit("two words"))), names.similarity(names.trigrams(F.lit("")), names.trigrams(F.lit("")))).first()
    assert round(row[0], 4) == 0.3636 and row[1] == 0.0


@pytest.mark.parametrize(
    ("word", "key"),
    [
        ("GUMBO", "KM"), ("Jackson", "JKSN"), ("Mitchell", "MXL"), ("Laugh", "LF"), ("Smith", "SM0"), ("Thumb", "0M"), ("Phone", "FN"), ("Knight", "NFT"), ("night", "NFT"), ("Wright", "RFT"), ("Xavier", "SFR"), ("Whitney", "WTN"), ("School", "SKL"), ("Christine", "KRSTN"),
        ("Bridge", "BRJ"), ("Nation", "NXN"), ("Science", "SNS"), ("Vaughn", "FFN"), ("Sharon", "XRN"), ("Accident", "AKSTNT"), ("Gnome", "NM"), ("Sign", "SN"), ("O'Brien", "OBRN"), ("Quick", "KK"), ("", ""), ("123", ""),
    ],
)
def test_metaphone(word, key):
    assert names.metaphone(word) == key


MAIL = """On Tue, Apr 16, 2019 at 8:19 AM Someone <x at y> wrote:

> quoted one
>
But all of this is body text.

So let's drop it.
> quoted again
--
Name (site)
> late quote
"""


def test_split_message(spark):
    body, quote, sign = values(spark, text.split_message, [MAIL])[0]
    assert body == "But all of this is body text.\n\nSo let's drop it."
    assert quote == "> quoted one\n>\n> quoted again\n> late quote" and sign == "--\nName (site)"
    assert tuple(values(spark, text.split_message, [None])[0]) == ("", "", "")
    assert tuple(values(spark, text.split_message, ["X schrieb:\nBest,\nme"])[0]) == ("", "", "Best,\nme")
    assert tuple(values(spark, text.split_message, ["text\nY wrote:\nmore"])[0]) == ("text\nY wrote:\nmore", "", "")


def test_split_message_takes_time_in_proportion_to_lines(spark):
    mail = "\n".join("> quoted" if k % 3 == 0 else f"line {k}" for k in range(12_000))
    started = time.monotonic()
    body, quote, sign = values(spark, text.split_message, [f"X wrote:\n{mail}\nThanks\nme"])[0]
    assert body == "\n".join(f"line {k}" for k in range(12_000) if k % 3) and quote == "\n".join(["> quoted"] * 4000) and sign == "Thanks\nme"
    assert time.monotonic() - started < 20


def test_terms(spark):
    assert values(spark, lambda c: text.term_count(c, ["Foo", "foo bar", "native"]), ["foo bar FOO food native", None]) == [2, 0]
    assert values(spark, lambda c: text.term_examples(c, ["Foo", "foo bar"]), ["foo bar FOO food"]) == [["foo", "foo bar"]]


def test_dates(spark):
    got = spark.createDataFrame([("2021-08-01 03:45:56",), ("Thu, 23 May 2002 23.19.24 +0200",)], "x string").select(F.date_format(text.resolve_date(F.col("x")), "yyyy-MM-dd HH:mm:ss")).collect()
    assert [r[0] for r in got] == ["2021-08-01 03:45:56", "2002-05-23 21:19:24"]
    with pytest.raises(Exception, match="no date"):
        values(spark, text.resolve_date, ["hey there"])


def test_small_texts(spark):
    assert values(spark, text.word_count, ["one two, three_four é 5", None]) == [5, 0]
    assert values(spark, text.status_class, ["Final", "April Fool!", "Draft x", "odd"]) == ["good", "bad", "other", "unknown"]
    assert values(spark, text.without_nul, ["a\x00b"]) == ["a<NULL>b"]
    assert values(spark, text.short_remote, ["git@host.org:a/b.git", "https://host.org/a"]) == ["host.org/a/b.git", "host.org/a"]


def test_means_of_the_largest(spark):
    many = [float(x) for x in range(1000)]
    assert values(spark, lambda c: numbers.top_n_mean(c, 10), [many, [1.0, 2.0, 3.0], []], "array<double>") == [994.5, 2.0, None]
    assert values(spark, lambda c: numbers.top_n_pct_mean(c, 10), [many, [5.0], []], "array<double>") == [949.5, 5.0, None]

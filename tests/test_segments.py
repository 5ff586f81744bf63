"""Truncation at words and at user-perceived characters: goldens, and random texts against a plain walk."""

import random
import unicodedata

import pyspark.sql.functions as F
import pytest

from loomstone.functions import segments, text

FAMILY = "\U0001f468‍\U0001f469‍\U0001f467‍\U0001f466"
THUMB = "\U0001f44d\U0001f3fd"
BRAZIL, STATES = "\U0001f1e7\U0001f1f7", "\U0001f1fa\U0001f1f8"
THAI = "สวัสดีชาว"  # 9 code points, 7 clusters
GOLDENS = [
    # text, budget in UTF-16 units, words, clusters
    ("one two three", 9, "one two ", "one two t"),
    ("one two three", 13, "one two three", "one two three"),
    ("can't stop", 4, "", "can'"),
    ("can't stop", 5, "can't", "can't"),
    ("3.14 rad", 3, "", "3.1"),
    ("3.14 rad", 4, "3.14", "3.14"),
    ("a. b", 2, "a.", "a."),
    ("a:b", 2, "a:", "a:"),
    ("ab_cd ef", 4, "", "ab_c"),
    ("a  b", 2, "a", "a "),
    (FAMILY * 2, 21, FAMILY, FAMILY),
    (FAMILY, 10, "", ""),
    (THUMB * 2, 7, THUMB, THUMB),
    (BRAZIL + STATES, 6, BRAZIL, BRAZIL),
    (BRAZIL + STATES, 8, BRAZIL + STATES, BRAZIL + STATES),
    ("éé", 3, "", "é"),
    ("x é́́", 4, "x ", "x "),
    (THAI, 2, THAI[:1], THAI[:1]),
    (THAI, 3, THAI[:3], THAI[:3]),
    ("日本語", 2, "日本", "日本"),
    ("カタカナ", 3, "", "カタカ"),
    ("한글", 5, "", "한"),
    ("צה\"ל ab", 3, "", "צה\""),
    ("\r\nab", 1, "", ""),
    ("\r\nab", 3, "\r\n", "\r\na"),
    ("", 3, "", ""),
]


@pytest.mark.parametrize(("given", "most", "words", "clusters"), GOLDENS)
def test_prefixes_end_at_cuts(spark, given, most, words, clusters):
    df = spark.createDataFrame([(given,)], "t string")
    row = df.select(segments.longest_prefix(F.col("t"), most, segments.WORD_CUT).alias("w"), segments.longest_prefix(F.col("t"), most, segments.CLUSTER_CUT).alias("c"), segments.units("t").alias("n")).first()
    assert (row.w, row.c, row.n) == (words, clusters, len(given.encode("utf-16-be")) // 2)


def plain_words(t):
    """Words of Latin texts with blanks, digits and marks, by a walk over clusters of a base and its marks."""
    clusters = []
    for ch in t:
        if clusters and unicodedata.category(ch).startswith("M"):
            clusters[-1] += ch
        else:
            clusters.append(ch)
    kind = lambda c: "L" if c[0].isalpha() else "N" if c[0].isdigit() else "_" if c[0] == "_" else " " if c[0] == " " else c[0]
    out = []
    for i, c in enumerate(clusters):
        k, before = kind(c), kind(clusters[i - 1]) if i else ""
        after, early = kind(clusters[i + 1]) if i + 1 < len(clusters) else "", kind(clusters[i - 2]) if i > 1 else ""
        joins = (k in "LN_" and before and before in "LN_") or (k == " " and before == " " and len(clusters[i - 1]) == 1)
        joins = joins or (k in ".'" and before == after == "L") or (k == "L" and before in (".", "'") and early == "L")
        joins = joins or (k in ".,'" and before == after == "N") or (k == "N" and before in (".", ",", "'") and early == "N")
        if joins and out:
            out[-1] += c
        else:
            out.append(c)
    return out, clusters


def longest(parts, most):
    out = ""
    for p in parts:
        if len((out + p).encode("utf-16-be")) // 2 > most:
            break
        out += p
    return out


def test_random_texts_against_a_walk(spark):
    rnd = random.Random(3)
    rows = [("".join(rnd.choice("abé1_ .,'!́ ") for _ in range(rnd.randint(1, 25))).lstrip("́"),) for _ in range(800)]
    df = spark.createDataFrame(rows, "t string")
    for most in (1, 5, 11):
        got = df.select("t", segments.longest_prefix(F.col("t"), most, segments.WORD_CUT).alias("w"), segments.longest_prefix(F.col("t"), most, segments.CLUSTER_CUT).alias("c")).collect()
        for r in got:
            words, clusters = plain_words(r.t)
            assert (r.w, r.c) == (longest(words, most), longest(clusters, most)), (r.t, most)


def test_truncation(spark):
    def cut(given, most):
        return spark.createDataFrame([(given,)], "t string").select(text.truncate_text(F.col("t"), most)).first()[0]

    assert cut(None, 5) is None
    assert cut("x" * 50, 50) == "x" * 50
    assert cut("one\n\ntwo\n\n\nthree four", 9) == "one\n\ntwo"
    assert cut("Uma frase razoavelmente longa aqui.", 5) == "Uma"
    assert cut("Ambiente descontraído \U0001f680\U0001f680\U0001f680 não", 27) == "Ambiente descontraído \U0001f680\U0001f680"
    assert cut("\U0001f680" * 10, 5) == "\U0001f680" * 2
    assert cut("  " + "y" * 30, 2) == ""
    assert cut("z" * 300_000, 8000) == "z" * 8000
    assert cut("ab " * 100_000, 7999) == ("ab " * 2666).rstrip()
    assert cut("e" + "́" * 100, 50) == ""

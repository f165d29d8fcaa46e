"""Held-out accuracy and defined cases of language identification."""

import zlib

import pytest

from saleslens.llm import langid, queries

from . import brute


def trains(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 != 0


def test_whole_table_against_plain_version(spark, sf_dir):
    """Every row of the query, against a version that shares no code with the operator."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    want = brute.languages(rows, trains)
    got = queries.op10_language(spark, sf_dir).collect()
    assert len(got) == len(rows)
    assert all((r.lang_pred, r.rejected) == want[r.doc_id][::2] and abs(r.score - want[r.doc_id][1]) < 1e-12 for r in got)


def test_blocks_are_drawn_from_whole_texts(spark):
    """A text that opens with another language is learnt from all of its parts; the bound holds; repeated rows and ties."""
    text = "zzz " * 3000 + "und der schnelle braune fuchs " * 3000
    df = spark.createDataFrame([(1, text, "de"), (2, "the quick brown fox " * 2000, "en"), (2, "the quick brown fox " * 2000, "en"), (3, None, "en"), (4, "12 34", "xx")], "doc_id long, text string, lang string")
    model = langid.fit_dictionaries(df, blocks_per_lang=20, block_chars=100)
    assert set(model.dictionaries) == {"de", "en"} and all(len(d) <= 20 * 101 for d in model.dictionaries.values())
    assert b"zzz" in model.dictionaries["de"] and b"fuchs" in model.dictionaries["de"]
    assert langid.fit_dictionaries(df.repartition(5), blocks_per_lang=20, block_chars=100) == model
    asked = spark.createDataFrame([(1, "fuchs"), (1, "fuchs"), (2, "fuchs")], "doc_id long, text string")
    same = {(r.lang_pred, r.score, r.rejected) for r in langid.identify(asked, model).collect()}
    assert len(same) == 1
    tie = langid.LanguageModel({"b": b"same words", "a": b"same words"})
    assert {(r.lang_pred, r.score, r.rejected) for r in langid.identify(asked, tie).collect()} == {("a", 0.0, True)}
    with pytest.raises(ValueError):
        langid.fit_dictionaries(df, max_languages=1)


def test_held_out_accuracy(spark, sf_dir):
    got = queries.op10_language(spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    known = [r for r in rows if r.held_out and r.lang is not None and not r.rejected]
    assert known and sum(r.lang == r.lang_pred for r in known) >= 0.95 * len(known)


def test_defined_cases(spark):
    model = langid.LanguageModel({"aa": b"the quick brown fox and the lazy dog", "bb": b"der schnelle braune fuchs und der faule hund"})
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the lazy dog and the quick brown fox"), (5, "der faule hund und der schnelle braune fuchs " * 3000), (None, "α")]
    df = spark.createDataFrame([(*r, "x", 0.0) for r in rows], "doc_id long, text string, Lang_Pred string, score double")
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in langid.identify(df, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", True)
    assert got[4] == ("aa", False) and got[5] == ("bb", False) and None in got
    assert langid.identify(df.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.identify(df, langid.LanguageModel({})).collect()} == {"und"}
    assert langid.fit_dictionaries(df.limit(0).withColumnRenamed("Lang_Pred", "lang")).dictionaries == {}

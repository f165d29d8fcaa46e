"""The pipeline against its plain definition, stage by stage."""

import zlib

import corpus_pipeline
from saleslens.llm import pii, queries
from saleslens.llm.common import materialize

from . import brute, test_neardup


def test_stages_against_definition(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    now, texts = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in now.collect()]
        now = materialize(stage(spark, now, sf_dir), f"test-{name}")
        rows = now.collect()
        kept = sorted(r.doc_id for r in rows)
        if name != "mix":
            assert now.columns == columns
        if name == "language":
            judged = brute.languages([(r.doc_id, r.text, r.lang) for r in docs.collect()], lambda i: zlib.crc32(str(i).encode()) % 5 != 0)
            assert kept == sorted(i for i, (_, _, rejected) in judged.items() if not rejected)
        elif name == "near_dedup":
            assert kept == test_neardup.kept([b[:2] for b in before])
        elif name == "decontaminate":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            hit = {d for d, _ in brute.contaminated([b[:2] for b in before], bench, min_tokens=5)}
            assert hit and kept == sorted(i for i, _, _ in before if i not in hit)
        elif name == "pseudonymize":
            assert kept == sorted(i for i, _, _ in before)
            assert all(r.n_chars == len(r.text) for r in rows)
            texts = {i: t for i, t, _ in before}
            assert {r.doc_id: r.text for r in rows} == {i: brute.pseudonymized(t, queries.PII_KEY, pii)[0] for i, t in texts.items()}
            assert any(r.text != texts[r.doc_id] for r in rows)
        else:
            label = {}
            for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect():
                label[r.doc_id] = max(r.quality, label.get(r.doc_id, 0)) if r.quality is not None else label.get(r.doc_id)
            value = {1: queries.GOOD, 0: queries.BAD, None: queries.UNKNOWN}
            want = brute.mixed([(i, s, len(brute.words(t)), value[label.get(i)]) for i, t, s in before])
            assert {r.doc_id: r.taken for r in rows} == {i: n for i, n in want.items() if n > 0}


def test_run_gives_the_same(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)


def test_defined_cases_of_every_stage(spark, sf_dir, tmp_path):
    """Nulls, ties, repeated rows and ids, long texts, extra and clashing columns, empty tables."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    plain = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null and length(text) > 300").orderBy("doc_id").limit(6).collect()]
    rows = [(1, plain[0], "en", "a", 1), (1, plain[0], "en", "a", 1), (1, plain[1], "en", "a", 1), (None, plain[2], None, None, 1), (None, plain[2], None, None, 1), (None, bench, "en", "a", 1),
            (2, bench, "en", "b", 1), (2, plain[3], "en", "b", None), (3, None, "en", "b", None), (4, "", "en", "b", 0), (5, "!?", None, None, 2), (6, (plain[4] + " ") * 200 + "x@y.org", "en", "b", 9)]
    docs = spark.createDataFrame([(*r, "extra", 1.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, TAKEN string, `a.b` double")
    text = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    by = dict(corpus_pipeline.STAGES)
    assert text(by["near_dedup"](spark, docs, sf_dir)) == sorted([(1, plain[0]), (1, plain[1]), (None, plain[2]), (2, bench), (2, plain[3]), (3, None), (5, "!?"), rows[-1][:2]], key=repr)
    assert text(by["decontaminate"](spark, docs, sf_dir)) == sorted((r[:2] for r in rows if r[1] != bench), key=repr)
    changed = by["pseudonymize"](spark, docs, sf_dir)
    assert changed.columns == docs.columns and changed.count() == len(rows) and {r.n_chars for r in changed.where("text is null").collect()} == {None}
    assert not {None, "", "!?"} & {t for _, t in text(by["language"](spark, docs, sf_dir))}
    taken = by["mix"](spark, docs, sf_dir)
    assert {c.lower() for c in docs.columns} - {c.lower() for c in taken.columns} == set() and all(r.taken > 0 and r.size > 0 for r in taken.collect())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name

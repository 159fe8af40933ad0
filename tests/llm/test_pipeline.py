"""The pipeline against a plain version, stage by stage, and as the tool runs it."""

import collections
import hashlib

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from touchline.llm import bpe, langid, mixing, secrets

from .test_operators import BPE, SF, brute_links, public_tokenizers


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "rows")
        out.append((docs, stage(spark, docs, SF).write.parquet(path), docs := spark.read.parquet(path)))
    return [(a, b) for a, _, b in out]


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    for _, after in stages[:-1]:
        assert set(after.columns) == set(pipeline.COLUMNS)


def test_language_keeps_all_that_has_one(stages):
    before, after = stages[0]
    languages, logs = langid.train(before)
    keep = {r.doc_id for r in langid.predict(before, languages, logs).collect() if r.lang_pred != "und" and r.score >= pipeline.LEAST_SHARE}
    assert {r.doc_id for r in after.collect()} == keep and len(keep) >= 0.99 * before.count()


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, _, c in brute_links(rows) if i == c)


def test_secrets_go_and_documents_stay(stages):
    before, after = stages[2]
    assert before.count() == after.count() and after.where(F.col("n_chars") != F.length("text")).join(before, ["doc_id", "n_chars"], "left_anti").count() == 0
    spans = secrets.scan(after, secrets.train(secrets.labelled_samples(before)))
    assert spans.where(F.size("base") > 0).count() == 0
    clean = secrets.scan(before, secrets.train(secrets.labelled_samples(before))).where(F.size("found") == 0).select("doc_id")
    assert clean.join(before, "doc_id").join(after.select("doc_id", F.col("text").alias("t")), "doc_id").where("t <> text").count() == 0


def test_mix_repeats_documents_as_often_as_it_takes_them(stages):
    before, after = stages[3]
    want = {r.doc_id: r.copies for r in mixing.mix(before).where("copies > 0").collect()}
    assert collections.Counter(r.doc_id for r in after.collect()) == want


def test_tokens_equal_the_library(stages):
    before, after = stages[4]
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder(BPE, public_tokenizers.PATTERN).v.ranks, special_tokens={})
    want = collections.Counter()
    for r in before.collect():
        ids = reference.encode_ordinary(r.text)
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after.collect()) == want


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(repr, pipeline.run(spark, SF).collect())) == sorted(map(repr, stages[-1][1].collect()))


def test_odd_rows_pass_through(spark):
    text = "the and of in " * 30
    rows = [(1, text, None, None, None), (1, text, None, None, None), (None, text, "en", "a", 5), (2, None, "en", "a", 0), (3, "", "en", "a", 0), (4, "123 !!", "en", "a", 6), (5, "der die und das " * 30, "de", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # 2, 3 and 4 have no letters; of the equal rows under 1 one stays; rows without an id stay
    kept = [[1, 1, 5, None], [1, 5, None], [1, 5, None]]
    for (_, stage), ids in zip(pipeline.STAGES, [*kept, None, None], strict=True):
        after = stage(spark, docs, SF)
        if ids is not None:
            assert sorted((r.doc_id for r in after.collect()), key=repr) == sorted(ids, key=repr)
            docs = after
        assert stage(spark, docs.where("1 = 0"), SF).count() == 0
        assert set(r.doc_id for r in after.collect()) <= {1, 5, None}


def test_different_texts_under_one_id_stay(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in ("gamma", "alpha", "beta"))
    rows = [(1, a), (1, b), (1, b), (1, b.upper()), (2, c), (3, c + " more"), (3, a + " la le"), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in pipeline.near_copies(spark, docs, SF).collect()]
    named = [(i, t.lower().split("0")[0]) for i, t in got if i is not None]
    assert len(got) == 4 and sorted(w for _, w in named) == ["alpha", "beta", "gamma"] and {(1, "alpha"), (2, "beta")} < set(named)


def test_documents_stay_where_no_language_was_learned(spark):
    docs = spark.createDataFrame([(i, f"the and of {i}", None, "x", 9) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert pipeline.language(spark, docs, SF).count() == 5

"""Operators with the settings that their queries use."""

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from folioflow.llm import jaccard, langid, mixing, packing, queries, toxicity, warc
from folioflow.llm._work import shared_dir, temporary

SMALL = "/root/testdata/sf0.01"


def left_behind(spark):
    store, root = pafs.FileSystem.from_uri(shared_dir(spark))
    return {f.base_name for f in store.get_file_info(pafs.FileSelector(root, allow_not_found=True))}


def test_languages_of_held_out_documents(spark):
    known = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    found = queries.op5_language_id(spark, SMALL).filter("held_out AND lang_pred <> 'und'").join(known.filter("lang IS NOT NULL"), "doc_id")
    rows = found.select("lang", "lang_pred").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    for lang in {r.lang for r in rows}:
        own = [r for r in rows if r.lang == lang]
        assert sum(r.lang == r.lang_pred for r in own) >= 0.8 * len(own)


def test_small_clean_corpora_stay(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(60)
    lettered = docs.filter(F.regexp_like("text", F.lit(r"\p{L}"))).select("doc_id").collect()
    kept = langid.keep_identified(docs).select("doc_id").collect()
    assert sorted(kept) == sorted(lettered)


def test_texts_of_no_language_go(spark):
    rng = np.random.default_rng(3)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter(F.regexp_like("text", F.lit(r"\p{L}")))
    encoded = ["".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 400)) for _ in range(20)]
    letters = [" ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 7)) for _ in range(60)) for _ in range(20)]
    rows = [(-1 - i, text, None, "junk", len(text)) for i, text in enumerate([*encoded, *letters])]
    kept = {r.doc_id for r in langid.keep_identified(docs.unionByName(spark.createDataFrame(rows, docs.schema))).select("doc_id").collect()}
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= kept
    assert len([i for i in kept if i < 0]) <= 4


def test_only_frequent_languages_are_learned(spark):
    rows = [(i, f"some text of number {i}", "en" if i < 40 else f"dirty {i}") for i in range(60)]
    net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_languages=3, least_steps=1)
    assert sorted(net.langs) == ["dirty 40", "dirty 41", "en"]


def test_archives_go_with_their_block(spark):
    before = left_behind(spark)
    pages = spark.createDataFrame([(i, f"u{i}", "x" * 2000 if i % 2 else f"page {i}") for i in range(40)], "page_id long, url string, html string")
    with temporary(spark):
        assert warc.round_trip(pages).count() == 40
    assert left_behind(spark) == before


def test_copies_are_found_with_and_without_a_broadcast(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"{i % 7}" * 1500 if i % 3 else f"page {i}") for i in range(100)], "page_id long, url string, html string")
    shown = ["page_id", "payload_sha1", "record_type", "refers_to"]
    both = [sorted(warc.classify(pages, few_groups=n).select(*shown).collect()) for n in (0, 1000)]
    assert both[0] == both[1] and sum(r.record_type == "revisit" for r in both[0]) == 59


def largest_batch(docs):
    """Bytes of the largest batch of texts that Python gets."""
    sizes = docs.select("text").mapInArrow(lambda batches: (b.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
    return sizes.agg(F.max("n")).first()[0]


def test_python_gets_texts_in_short_batches(spark, tmp_path, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    setting, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(setting)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat("id", F.repeat(F.lit(" word"), 2000)).alias("text")).coalesce(1)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    try:
        summarise = jaccard.summarise
        monkeypatch.setattr(jaccard, "summarise", lambda found, n: seen.append(largest_batch(docs)) or summarise(found, n))
        assert jaccard.similar_documents(docs.limit(3)).count() == 3 and spark.conf.get(setting) == before
        for module, name in ((langid, "keep_identified"), (toxicity, "keep_harmless"), (jaccard, "keep_one_each"), (mixing, "mix"), (packing, "pack")):
            monkeypatch.setattr(module, name, lambda docs, *_, **__: docs)
        for _, stage in pipeline.STAGES:
            spark.conf.set(setting, before)
            seen.append(largest_batch(stage(spark, docs, str(tmp_path))))
    finally:
        spark.conf.set(setting, before)
    assert len(seen) == 6 and max(seen) < 8 << 20 < largest_batch(docs)

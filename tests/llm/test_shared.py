from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from meshwork.llm import decontamination, quality_rules, secret_scans
from meshwork.llm.shared import Packed
from tests.llm.texts import ODD, documents


def test_packed(spark):
    """Other columns, of any name, and the text come back as they were, or changed."""
    docs = documents(spark, extra=True).withColumn("__row", F.lit("x")).withColumn("c0", F.lit(5))
    packed = Packed(docs, "text")
    assert packed.unpack(packed.rows).schema.simpleString() == docs.schema.simpleString()
    assert Counter(map(repr, packed.unpack(packed.rows).collect())) == Counter(map(repr, docs.collect()))
    got = packed.unpack(packed.rows, F.when(F.col("__text") == "one", F.lit("two"))).collect()
    assert Counter(r.text for r in got) == Counter("two" if t == "one" else t for t in (r.text for r in docs.collect()))


def test_texts_alone_and_of_other_types(spark):
    """A table of texts and nothing else, and texts that are bytes."""
    texts = [t for t in ODD if t] + ["key sk9fQ2mZ7xKp4LvT8wRb3NcYh6 and token=abcdefghijklmnop12 here with some more words"]
    docs = spark.createDataFrame([(t, "h", i) for i, t in enumerate(texts)], "text string, source string, doc_id long")
    bench = spark.createDataFrame([(1, "zzz qqq")], "item_id long, text string")
    alone = docs.select("text")
    assert Counter(decontamination.remove_spans(alone, bench).collect()) == Counter(alone.collect())
    assert "[SECRET]" in secret_scans.redact(alone).orderBy(F.desc(F.length("text"))).agg(F.concat_ws(" ", F.collect_list("text")).alias("x")).head().x
    raw = docs.withColumn("text", F.col("text").cast("binary"))
    kept = quality_rules.keep_documents(raw)
    assert kept.schema == raw.schema and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in quality_rules.keep_documents(docs).collect())
    clean = {r.doc_id: r.text for r in secret_scans.redact(raw).collect()}
    assert clean == {r.doc_id: bytearray(r.text.encode()) for r in secret_scans.redact(docs).collect()}


def test_stages_keep_the_columns(spark, tmp_path):
    docs = documents(spark)
    spark.createDataFrame([(1, "zzz qqq")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "SentencePiece encoding"]
    for _, stage in corpus_pipeline.STAGES[2:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString() and out.count() == docs.count()

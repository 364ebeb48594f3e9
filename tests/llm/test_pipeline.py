import re

from pyspark.sql import functions as F

import corpus_pipeline
from meshwork.llm import piece_sampling, quality_rules
from tests.llm.test_ngram_join import brute
from tests.llm.test_text_rules import base_counts, brute_benchmark
from tests.llm.test_native import SECRETS, base_spans
from tests.llm.texts import ODD, documents, empty

WORDS = "some plain words that stand around each secret so that the text is long enough to be kept here "
TEXTS = [*ODD, *(f"{WORDS}{i} {s}" for i, s in enumerate(SECRETS)), *(f"{WORDS}{'tail ' * 0}number {i} of the near copies" for i in (1, 1, 2))]
ITEMS = [(1, "fox jumps over the lazy dog while seven wizards quietly box near"), (2, "that stand around")]


def expected(rows):
    """rows: (doc_id, text); the texts that stay."""
    rows = [r for r in rows if not base_counts(r[1])[5]]
    kept, seen = [], set()
    for (d, t), (_, n, c) in zip(rows, brute(rows, 5, 80), strict=True):
        if n == 0 or (d == c and (c not in seen)):
            seen.add(c)
            kept.append((d, t))
    out = []
    for d, t in kept:
        n, hit, _ = brute_benchmark(t, ITEMS)
        if hit <= 0.5 * n:
            out.append((d, t, hit))
    return out


def test_stages(spark, tmp_path):
    docs = documents(spark, TEXTS).filter("doc_id is not null")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = expected(rows)
    assert sorted(got) == sorted(d for d, _, _ in want)
    p = piece_sampling.pieces("piece_bpe_32k.model", 1.0)
    for d, t, hit in want:
        r = got[d]
        assert r.lossless and p.decode(r.ids) == r.text and r.n_chars == len(r.text)
        assert base_spans(r.text) == []
        if not hit and not base_spans(t) and "sk9f" not in t:
            assert r.text == t
        assert not re.search("that stand around", r.text)
    assert sum(r.text.count("[SECRET]") for r in got.values()) >= 6


def test_columns_and_empty(spark, tmp_path):
    """Columns of other names, as the operators' own, stay as they are."""
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clash = {c: F.lit("mine") for c in ("n_words", "host_key", "lines", "family", "n_hit", "spans", "items", "kept", "ids", "key", "n_shingles", "group_key")}
    docs = documents(spark).withColumns(clash)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and 0 < out.filter("n_words = 'mine' and ids = 'mine'").count() <= docs.count()
        assert stage(spark, empty(spark), str(tmp_path)).collect() == []
    last = corpus_pipeline.STAGES[4][1](spark, docs, "")
    assert sorted(last.columns) == sorted([*docs.columns, "lossless"]) and last.filter("lossless").count() == docs.count()
    kept = quality_rules.keep_documents(docs, max_broadcast=-1)
    assert kept.columns == docs.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, quality_rules.keep_documents(docs).collect()))

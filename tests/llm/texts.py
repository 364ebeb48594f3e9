"""Texts of all the odd kinds that operators have to take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly box near old stone walls and nobody minds"
ODD = [
    None, "", " ", "\n\n \t\n", "one", "one two", "é û　ü Ünïcode ▁mark▁ a▁b", "  two  spaces   here ", "tab\tand\x0bvt\x0cff\r\ncr", "İ￿ 😀😀 emoji",
    _BASE, _BASE, _BASE.upper(), _BASE + ".", _BASE + "\n" + _BASE, "a a a a a a a a a a a a", "x" * 5000, "word " * 3000, "line one\nline one\n\nline two\nline one",
    "<s> </s> <unk> <0x0A> special", "# * $ % & | < >" * 3, "lorem ipsum " + _BASE + " dolor sit amet", "zero\x00byte here",
]


def documents(spark, texts=ODD, extra=False):
    rows = [(i if i != 4 else None, t, None if i % 3 == 0 else "en", None if i % 5 == 0 else f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += rows[-2:]  # repeated rows
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for c in ("n", "size", "rank", "row", "__text", "families", "start", "item_id", "label", "hash", "key", "shard", "gram", "spans", "tokens"):
            df = df.withColumn(c, F.lit(1))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)

"""Token counts by a two-tier lookup of pre-token lengths.

A text is cut into pre-tokens that the tokenizer can never merge across, so the lengths of its pre-tokens add up to the
length of the text.  For SentencePiece models that is before each run of spaces, as no piece has a space after another
character; this is checked when the model is opened, and a model that breaks the rule gets whole texts.

Tier one is a compact table of the corpus' frequent pre-tokens with their lengths, broadcast to the tasks.  It comes from
one pass over all texts in which each task keeps a bounded counter and reports its ``TOP`` most frequent pre-tokens; only
these reports are merged, so the corpus' pre-tokens are never shuffled.  Tier two is a cache in each worker that encodes
what the table lacks.  The table only saves time: any table gives the same counts.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as k
from .shared import small_batches

MARK = "▁"  # stands for a space in SentencePiece models
TOP = 1024  # pre-tokens that a task reports
COUNTED = 100_000  # pre-tokens that a task's counter holds at most, but for those of one text
TABLE = 32_768  # entries of the broadcast table at most
CACHE = 400_000  # entries of a worker's cache at most
LONG = 64  # longer pre-tokens are neither reported nor cached


class PieceTokenizer:
    """A SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = model.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        normal = spec.normalizer_spec
        plain = normal.name == "identity" and normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces
        self.cut = plain and not any(MARK in p.piece.lstrip(MARK) for p in spec.pieces)

    def split(self, text: str) -> list[str]:
        """Pre-tokens without the first of the spaces before each, which the library puts in front of what it encodes."""
        if not self.cut:
            return [text] if text else []
        text = text.replace(MARK, " ")
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [x[1:] for x in re.findall(" +[^ ]*", " " + text)]
        return text.split(" ") if text else []

    def lengths(self, tokens: list[str]) -> list[int]:
        """Lengths of pre-tokens; the empty one is a lone space, which the library would leave out."""
        lone = 1 if self.model.piece_to_id(MARK) != self.model.unk_id() else len(MARK.encode())
        return [len(x) if t or not self.cut else lone for t, x in zip(tokens, self.model.encode(tokens, num_threads=1), strict=True)]


class JsonTokenizer:
    """A file of the tokenizers library; its own pre-tokenizer decides where texts are cut, so they go to it whole."""

    cut = False

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_padding()
        self.model.no_truncation()

    def split(self, text: str) -> list[str]:
        return [text] if text else []

    def lengths(self, tokens: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(tokens, add_special_tokens=False)]


_open: dict[str, PieceTokenizer | JsonTokenizer] = {}


def tokenizer(name: str) -> PieceTokenizer | JsonTokenizer:
    """The tokenizer in a file of the public_tokenizers package, or at a path that all workers have; opened once a worker."""
    if name not in _open:
        path = name
        if os.path.sep not in name:
            import public_tokenizers

            path = str(public_tokenizers.path(name))
        _open[name] = PieceTokenizer(path) if path.endswith(".model") else JsonTokenizer(path)
    return _open[name]


class Lengths:
    """Lengths of texts through both tiers."""

    def __init__(self, name: str, table: dict[str, int]):
        self.tokenizer, self.table = tokenizer(name), table
        self.cache = dict(table)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.tokenizer.split(text)
        found = [*map(self.cache.get, parts)]
        if None not in found:
            return sum(found)
        if len(self.cache) > CACHE:
            self.cache = dict(self.table)
            found = [*map(self.cache.get, parts)]
        misses = [p for p, n in zip(parts, found, strict=True) if n is None]
        new = dict.fromkeys(misses)
        new = dict(zip(new, self.tokenizer.lengths([*new]), strict=True))
        self.cache.update((p, n) for p, n in new.items() if len(p) <= LONG)
        return sum(n for n in found if n is not None) + sum(map(new.__getitem__, misses))


def frequent(docs: DataFrame, text: str, model: str, table: int = TABLE) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of all texts; at most ``table``, and none where texts are not cut."""
    if not tokenizer(model).cut:
        return {}

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, seen = tokenizer(model), Counter()
        for b in batches:
            for x in b.column(0):
                seen.update(t.split(x.as_py() or ""))
                if len(seen) > COUNTED:
                    seen = Counter(dict(seen.most_common(COUNTED // 4)))
        top = [(p, n) for p, n in seen.most_common(TOP) if len(p) <= LONG and n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["token", "n"])

    reports = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(k.task(report), "token string, n long")
    top = reports.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(table).collect()
    names = [r.token for r in top]
    return dict(zip(names, tokenizer(model).lengths(names), strict=True)) if names else {}


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", text: str = "text", keys: tuple[str, ...] = ("doc_id",), limit: int = 4096) -> DataFrame:
    """keys, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of each row.

    Tokens are those of the library without begin, end or other added tokens, truncation or padding.  Null and empty texts
    have none; repeated rows count alike; other columns do not matter; ``model`` is a file name of the
    public_tokenizers package or a path that all workers have.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, text, model))
    names = [*keys, "n_bytes", "n_tokens", "over_limit"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = Lengths(model, shared.value)
        for b in batches:
            texts = b.column(len(keys))
            n = pa.array([length(x.as_py()) for x in texts], pa.int64())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), size, n, pc.greater(n, limit)], names)

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)
    return docs.select(*keys, F.col(text).cast("string").alias("__text")).mapInArrow(k.task(count), f"{kinds}, n_bytes long, n_tokens long, over_limit boolean")

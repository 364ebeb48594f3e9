"""Quality rules: counts of words, symbols and repeats per text, and lines that too many documents of a host share.

Method: every line is normalised (ASCII lower case, white space collapsed) and hashed; for each host the distinct
documents with a line are counted; lines above the limit are taken out, and a document of which hardly anything is left
is rejected.  Documents with the same lines (as normalised, blank ones aside) count as one, so a clean text does not fall because it was
copied often.

One scan of the texts: all that follows works on hashes, which are checkpointed once.  Counts are combined before they are
shuffled, so neither a line that a third of all documents have nor a host that has them gathers in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as k
from .shared import Packed, checkpoint, small_batches

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

_FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, host_key long, text_key long, text_key2 long, lines array<long>, line_words array<int>"
#: What tells a document of a host: two hashes of its line hashes, 128 bits.
_TEXT = ("host_key", "text_key", "text_key2")


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of word hashes."""
    return k.span_hashes(values, starts, ends) if len(values) else np.zeros(len(starts), np.uint64)


def features(s: k.Slice) -> dict[str, np.ndarray | pa.Array]:
    """What the rules need to know of each text of a slice."""
    w = k.words(s, k.NOT_SPACE)
    rows = s.rows
    folded = k.words(s, k.NOT_SPACE, k.LOWER).hashes
    chars = k.sums(k.CHAR_START[s.data] & k.NOT_SPACE[s.data], s.offsets)
    symbols = k.sums(_SYMBOL[s.data], s.offsets)
    word_edges = np.concatenate([[0], np.cumsum(w.counts)])

    lines = k.words(s, k.NOT_NEWLINE)
    begin, finish = np.searchsorted(w.starts, lines.starts), np.searchsorted(w.starts, lines.ends)
    full = finish > begin
    salt = k.mix(np.arange(rows, dtype=np.uint64) + np.uint64(1))
    keys = lines.hashes[full] ^ salt[lines.row[full]]
    _, first = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    dup_lines = np.bincount(lines.row[full][later], minlength=rows)

    h, at = k.window_hashes(w, _WINDOW)
    again = at[k.repeated(h ^ salt[w.row[at]])] if len(h) else at
    cover = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + _WINDOW, -1)
    repeat_words = np.bincount(w.row[np.cumsum(cover[:-1]) > 0], minlength=rows)

    normal = _sequence_hashes(folded, begin[full], finish[full])
    line_row = lines.row[full]
    edges = np.searchsorted(line_row, np.arange(rows + 1))
    texts = [_sequence_hashes(k.mix(normal ^ np.uint64(seed)), edges[:-1], edges[1:]) for seed in (0x51, 0xA7)]
    # a line counts once a document; its words add up
    pair = normal ^ salt[line_row]
    _, one, inverse = np.unique(pair, return_index=True, return_inverse=True)
    total = np.bincount(inverse, weights=(finish - begin)[full], minlength=len(one)).astype(np.int64)
    order = np.argsort(line_row[one], kind="stable")
    each = np.bincount(line_row[one], minlength=rows)
    return {
        "n_words": w.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words,
        "text_key": texts[0].view(np.int64), "text_key2": texts[1].view(np.int64),
        "lines": _lists(normal[one][order].view(np.int64), each, pa.int64()), "line_words": _lists(total[order], each, pa.int32()),
    }


def _host_hashes(hosts: pa.Array) -> np.ndarray:
    return np.concatenate([k.span_hashes(s.data, s.offsets[:-1], s.offsets[1:]) for s in k.slices(hosts)]).view(np.int64) if len(hosts) else np.zeros(0, np.int64)


def _scan(text: str, host: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in k.slices(b.column(b.schema.get_field_index(text))):
                part = b.slice(s.first, s.rows)
                got = features(s)
                got["host_key"] = _host_hashes(part.column(part.schema.get_field_index(host)))
                made = {x: v if isinstance(v, pa.Array) else pa.array(v) for x, v in got.items()}
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(x)) for x in names[: -len(got)]), *(made[x] for x in names[-len(got) :])], names)

    return run


def _each_line(found: DataFrame) -> DataFrame:
    """(host_key, text_key, text_key2, line, words), once for each distinct document of a host."""
    once = found.groupBy(*_TEXT).agg(F.first("lines").alias("lines"), F.first("line_words").alias("line_words"))  # equal in equal texts
    return once.select(*_TEXT, F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select(*_TEXT, F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))


def frequent_lines(found: DataFrame, line_limit: int) -> DataFrame:
    """(host_key, line) of lines that more than line_limit distinct documents of a host have."""
    counts = _each_line(found).groupBy("host_key", "line").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > line_limit).select("host_key", "line")


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", keys: tuple[str, ...] = ("doc_id",), line_limit: int = 20, keep_share: float = 0.15, max_broadcast: int = 2_000_000) -> DataFrame:
    """Returns keys, the base counts, removed_words, base_failed and kept for each row of docs.

    Null text has no words, null hosts share one host, repeated rows are judged alike, an empty table gives none, and columns other
    than the named ones do not matter.  The lines over the limit go to the tasks as a broadcast set of hashes if they are at most
    ``max_broadcast`` (16 bytes each), which are counted; beyond that they are joined, with the same result.
    """
    small_batches(docs.sparkSession)
    names = [*keys, *(x.split()[0] for x in _FEATURES.split(", "))]
    data = docs.select(*(F.col(c) for c in keys), F.col(text).cast("string").alias("__text"), F.col(host).cast("string").alias("__host"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)
    found = checkpoint(data.mapInArrow(k.task(_scan("__text", "__host", names)), f"{kinds}, {_FEATURES}"))
    over = checkpoint(frequent_lines(found, line_limit))
    if over.count() <= max_broadcast:
        removed = _removed_by_set(found, over, names)
    else:
        removed = _removed_by_join(found, over)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    depleted = (F.col("removed_words") > 0) & (F.col("n_words") - F.col("removed_words") < keep_share * F.col("n_words"))
    return removed.select(*keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", base_failed.alias("base_failed"), (~base_failed & ~depleted).alias("kept"))


def keep_documents(docs: DataFrame, text: str = "text", host: str = "source", line_limit: int = 20, keep_share: float = 0.15, max_broadcast: int = 2_000_000) -> DataFrame:
    """The rows of docs that quality_rules() keeps, as they are; texts are scanned twice and not shuffled."""
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in _FEATURES.split(", ")]
    data = docs.select(F.col(text).cast("string").alias("__text"), F.col(host).cast("string").alias("__host"))
    found = checkpoint(data.mapInArrow(k.task(_scan("__text", "__host", names)), _FEATURES).select(*_TEXT, "lines", "line_words"))
    over = checkpoint(frequent_lines(found, line_limit))
    packed = Packed(docs.withColumn("__host", F.col(host).cast("string")), text)
    at = packed.fields["__host"]
    rows = packed.rows.withColumn("__host", F.col("__row")[at])
    if over.count() > max_broadcast:  # whole rows go along
        kept = quality_rules(rows.withColumn("__body", F.col("__text")), "__text", "__host", ("__row", "__body"), line_limit, keep_share, max_broadcast).filter("kept")
        return packed.unpack(kept.withColumnRenamed("__body", "__text")).select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(_line_keys(over))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = k.HashSet(shared.value)
        for b in _scan("__text", "__host", ["__row", "__text", *names])(batches):
            got = {c: b.column(b.schema.get_field_index(c)) for c in names}
            n, again = got["n_words"].to_numpy(), got["n_repeat_words"].to_numpy()
            removed = _removed(frequent, got["host_key"].to_numpy(), got["lines"], got["line_words"])
            kept = (n >= MIN_WORDS) & (100 * again <= MAX_REPEATED_PERCENT * n) & ~((removed > 0) & (n - removed < keep_share * n))
            yield b.select(["__row", "__text"]).filter(pa.array(kept))

    kept = rows.mapInArrow(k.task(run), f"__row {packed.row_kind}, __text string")
    return packed.unpack(kept).select(*docs.columns)


def _combined(host: np.ndarray, line: np.ndarray) -> np.ndarray:
    return k.mix(line.view(np.uint64) + k.mix(host.view(np.uint64)))


def _line_keys(over: DataFrame) -> np.ndarray:
    rows = over.toArrow()  # the caller has checked the number of rows
    host, line = (rows.column(c).to_numpy().astype(np.int64) for c in ("host_key", "line"))
    return np.unique(_combined(host, line))


def _removed(frequent: k.HashSet, hosts: pa.Array | np.ndarray, lines: pa.ListArray, counts: pa.ListArray) -> np.ndarray:
    """Words in frequent lines of each row."""
    n = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    at = frequent.find(_combined(np.asarray(hosts)[row], lines.flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
    return np.bincount(row[at], weights=counts.flatten().to_numpy(zero_copy_only=False)[at], minlength=len(n)).astype(np.int64)


def _removed_by_set(found: DataFrame, over: DataFrame, names: list[str]) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast(_line_keys(over))
    kept = [n for n in names if n not in ("lines", "line_words", *_TEXT)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = k.HashSet(shared.value)
        for b in batches:
            removed = _removed(frequent, *(b.column(b.schema.get_field_index(x)) for x in ("host_key", "lines", "line_words")))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(x)) for x in kept), pa.array(removed)], [*kept, "removed_words"])

    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    return found.mapInArrow(k.task(run), ", ".join(f"`{x}` {kinds[x]}" for x in kept) + ", removed_words long")


def _removed_by_join(found: DataFrame, over: DataFrame) -> DataFrame:
    """The same by a join: words removed of each distinct document, then back to the rows."""
    sums = _each_line(found).join(over, ["host_key", "line"]).groupBy(*_TEXT).agg(F.sum("words").cast("long").alias("removed_words"))
    return found.join(sums, [*_TEXT], "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))


def remove_frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", line_limit: int = 20, max_broadcast: int = 2_000_000) -> DataFrame:
    """docs with the lines over the limit taken out of their texts (all other lines, blank ones too, stay as they are).

    Null texts stay null, null hosts are one host, and an empty table gives an empty one.  The lines are broadcast as in
    quality_rules(), or, if they are too many, each document is joined with those of its own lines that go.
    """
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in _FEATURES.split(", ")]
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).cast("string").alias("__text"), F.col(host).cast("string").alias("__host"))
    found = checkpoint(rows.drop("__row").mapInArrow(k.task(_scan("__text", "__host", names)), _FEATURES).select(*_TEXT, "lines", "line_words"))
    over = checkpoint(frequent_lines(found, line_limit))
    kind = f"__row {rows.schema['__row'].dataType.simpleString()}"
    if over.count() <= max_broadcast:
        shared = docs.sparkSession.sparkContext.broadcast(_line_keys(over))
        cut = rows.mapInArrow(k.task(_cut(["__row"], shared)), f"{kind}, __cut string")
    else:
        go = _each_line(found).join(over, ["host_key", "line"]).groupBy(*_TEXT).agg(F.collect_list("line").alias("__go"))  # at most a document's own lines
        keyed = rows.mapInArrow(k.task(_scan("__text", "__host", ["__row", "__text", "__host", *names])), f"{kind}, __text string, __host string, {_FEATURES}")
        joined = keyed.join(go, [*_TEXT], "left").select("__row", "__text", "__host", "__go")
        cut = joined.mapInArrow(k.task(_cut(["__row"], None)), f"{kind}, __cut string")
    out = cut.select(*(F.col("__cut").cast(docs.schema[c].dataType).alias(c) if c == text else F.col("__row")[c].alias(c) for c in docs.columns))
    return out


def _cut(carry: list[str], shared):
    """Batches with __cut, their __text without the lines of the broadcast set, or of __go where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = None if shared is None else k.HashSet(shared.value)
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
            texts, out = get("__text"), []
            hosts = _host_hashes(get("__host"))
            for s in k.slices(texts):
                w = k.words(s, k.NOT_SPACE, k.LOWER)
                lines = k.words(s, k.NOT_NEWLINE, hashed=False)
                begin, finish = np.searchsorted(w.starts, lines.starts), np.searchsorted(w.starts, lines.ends)
                full = np.flatnonzero(finish > begin)
                normal = _sequence_hashes(w.hashes, begin[full], finish[full])
                if frequent is not None:
                    gone = full[frequent.find(_combined(hosts[s.first + lines.row[full]], normal.view(np.int64)))]
                else:
                    go = get("__go").slice(s.first, s.rows)
                    row = np.repeat(np.arange(s.rows), pc.fill_null(pc.list_value_length(go), 0).to_numpy(zero_copy_only=False))
                    wanted = np.stack([row, go.flatten().to_numpy(zero_copy_only=False).astype(np.int64)], 1)
                    keys = np.sort(_combined(wanted[:, 0], wanted[:, 1]))
                    gone = full[k.member(_combined(lines.row[full], normal.view(np.int64)), keys)]
                out += _without(s, lines, gone)
            made = pa.array(_nulls(texts, out), pa.string())
            yield pa.RecordBatch.from_arrays([*(get(c) for c in carry), made], [*carry, "__cut"])

    return run


def _nulls(texts: pa.Array, out: list[str]) -> list[str | None]:
    return [x if there else None for there, x in zip(texts.is_valid().to_pylist(), out, strict=True)]


def _without(s: k.Slice, lines: k.Words, gone: np.ndarray) -> list[str]:
    """Each text of a slice without some lines; a line goes with the break behind it, the last one with that before it."""
    whole, out = s.data.tobytes(), []
    rows = lines.row[gone]
    for r in range(s.rows):
        a, z = int(s.offsets[r]), int(s.offsets[r + 1])
        mine = gone[np.searchsorted(rows, r) : np.searchsorted(rows, r + 1)]
        if not len(mine):
            out.append(whole[a:z].decode())
            continue
        parts, at = [], a
        for i in mine.tolist():
            parts.append(whole[at : lines.starts[i]])
            at = min(int(lines.ends[i]) + 1, z + 1)
        parts.append(whole[at:z])
        text = b"".join(parts)
        out.append((text[:-1] if at > z and text.endswith(b"\n") else text).decode())
    return out

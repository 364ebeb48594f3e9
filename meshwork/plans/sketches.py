"""Sketches of the vertices that each vertex reaches: HyperLogLog registers, a byte each, merged as arrays by Python workers.

Vertices are dealt in blocks of at most BLOCK_BYTES of registers; a block is one row, with its registers, what changed of them in the
round before, and its in-edges.  A round sends only registers that changed, at most once for each vertex and block that hears of it, and
merges what came by the largest.  So a round is one shuffle of packed rows, and once sketches come to rest little is sent.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
STEP_BYTES = 4 << 20
#: Kind 0 is a block, kind 1 a message to one: in that, edges are pairs (vertex of the block, row of the registers), changed is the number of these rows.
ROW = "block long, kind int, registers binary, changes binary, edges binary, estimates binary, total double, changed long"
_SCHEMA = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("registers", pa.binary()), ("changes", pa.binary()), ("edges", pa.binary()), ("estimates", pa.binary()), ("total", pa.float64()), ("changed", pa.int64())])


def block_count(vertices: int, log_size: int) -> int:
    return max(-(-(vertices << log_size) // BLOCK_BYTES), min(16, -(-vertices // 64)))


def _pack(registers: np.ndarray) -> bytes:
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(registers), asbytes=True)


def _unpack(packed: bytes, rows: int, size: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(packed, rows * size), np.uint8).reshape(rows, size)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


def first_registers(ids: np.ndarray, log_size: int) -> np.ndarray:
    """Sketches of the vertices alone: the hash's low bits name a register, the zeros that follow them are counted in it."""
    z = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    rest = (z >> np.uint64(log_size)) | np.uint64(1 << (63 - log_size))
    found = np.zeros((len(ids), 1 << log_size), np.uint8)
    found[np.arange(len(ids)), z & np.uint64((1 << log_size) - 1)] = np.frexp((rest & (~rest + np.uint64(1))).astype(np.float64))[1]
    return found


def estimates(registers: np.ndarray) -> np.ndarray:
    """Distinct members of each sketch, by Ertl's improved estimator: one formula for small and large sets, which never falls as registers grow."""
    size = registers.shape[1]
    powers = np.r_[0.0, np.exp2(-np.arange(1, 65.0))].astype(np.float32)
    out = np.empty(len(registers))
    step = max(1, STEP_BYTES // (8 * size))
    for at in range(0, len(registers), step):
        part = registers[at : at + step]
        x = 1 - np.count_nonzero(part, axis=1) / size
        zeros, weight = x.copy(), 1.0
        while x.any():
            x = np.where(x < 1e-150, 0.0, x * x)
            zeros += x * weight
            weight *= 2
        out[at : at + step] = size * size / (2 * math.log(2)) / (size * zeros + powers.take(part).sum(axis=1, dtype=np.float64))
    return out


def _touched(values: np.ndarray) -> np.ndarray:
    """Which rows have a value other than zero; rows are of 16 bytes or more, so eight are seen at once."""
    return values.view(np.uint64).any(axis=1)


def merge(into: np.ndarray, rows: np.ndarray, source: np.ndarray, picks: np.ndarray) -> None:
    """into[rows[i]] becomes its maximum with source[picks[i]], for all i; rows are in order."""
    step = max(1, STEP_BYTES // into.shape[1])
    for at in range(0, len(rows), step):
        r, p = rows[at : at + step], picks[at : at + step]
        while len(r):  # each row's first, then what is left of them; long runs at once
            starts = _starts(r)
            long = 2 * len(starts) < len(r)
            heard = np.maximum.reduceat(source[p], starts, axis=0) if long else source[p[starts]]
            into[r[starts]] = np.maximum(into[r[starts]], heard, out=heard)
            r, p = (r[:0], p[:0]) if long else (np.delete(r, starts), np.delete(p, starts))


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(v) for v in row.values() if isinstance(v, bytes))
        if size >= STEP_BYTES:
            yield pa.RecordBatch.from_pylist(held, _SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, _SCHEMA)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def begin(n: int, blocks: int, log_size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks from edges (block, to, s, d) in order: an edge goes from vertex s of block ``to`` to vertex d of the block.  Each block has a row with to = -1."""

    def block(number: int, parts: list[np.ndarray]) -> dict:
        registers = first_registers(np.arange(number, n, blocks), log_size)
        alone, packed = estimates(registers), _pack(registers)
        edges = np.concatenate(parts, axis=1)
        return {"block": number, "kind": 0, "registers": packed, "changes": packed, "edges": edges[:, edges[0] >= 0].tobytes(), "estimates": alone.tobytes(), "total": math.fsum(alone), "changed": len(alone)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        number, parts = None, []
        for batch in batches:
            blocks_of = batch.column(0).to_numpy()
            edges = np.stack([batch.column(i).to_numpy().astype(np.int32) for i in (1, 2, 3)])
            cuts = [*_starts(blocks_of), len(blocks_of)]
            for a, b in zip(cuts, cuts[1:]):
                if number is not None and blocks_of[a] != number:
                    yield block(number, parts)
                    parts = []
                number = int(blocks_of[a])
                parts.append(edges[:, a:b])
        if number is not None:
            yield block(number, parts)

    return lambda batches: _batches(rows(batches))


def send(log_size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The blocks, and what they have to say: to each block with edges into vertices that changed, either these vertices' changes or,
    if those are fewer rows, what each vertex there hears in all."""
    size = 1 << log_size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in _rows(batches):
            yield row | {"changes": None}
            if not row["changed"]:
                continue
            changes = _unpack(row["changes"], len(row["estimates"]) // 8, size)
            edges = np.frombuffer(row["edges"], np.int32).reshape(3, -1)
            to, s, d = edges[:, _touched(changes)[edges[2]]]
            cuts = [*_starts(to), len(to)]
            for a, b in zip(cuts, cuts[1:]):
                hearers, picks = s[a:b], d[a:b]
                starts = _starts(hearers)
                tellers, told = np.unique(picks, return_inverse=True)
                if len(starts) < len(tellers):
                    said = np.zeros((len(starts), size), np.uint8)
                    merge(said, np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, b - a])), changes, picks)
                    hearers, told = hearers[starts], np.arange(len(starts))
                else:
                    said = changes[tellers]
                yield {"block": int(to[a]), "kind": 1, "registers": _pack(said), "edges": np.stack([hearers, told.astype(np.int32)]).tobytes(), "changed": len(said)}

    return lambda batches: _batches(rows(batches))


def hear(log_size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks after a round, from rows in order of block and kind."""
    size = 1 << log_size

    def done(row: dict, old: np.ndarray | None, new: np.ndarray | None) -> dict:
        moved = new != old if new is not None else np.zeros((0, 16), bool)
        which = np.flatnonzero(_touched(moved))
        if not len(which):
            return row | {"changes": None, "changed": 0}
        counts = np.frombuffer(row["estimates"]).copy()
        counts[which] = estimates(new[which])
        return row | {"registers": _pack(new), "changes": _pack(new * moved), "estimates": counts.tobytes(), "total": math.fsum(counts), "changed": len(which)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        row = old = new = None
        for x in _rows(batches):
            if x["kind"] == 0:
                if row is not None:
                    yield done(row, old, new)
                row, old, new = x, None, None
                continue
            if new is None:
                old = _unpack(row["registers"], len(row["estimates"]) // 8, size)
                new = old.copy()
            hearers, told = np.frombuffer(x["edges"], np.int32).reshape(2, -1)
            merge(new, hearers, _unpack(x["registers"], x["changed"], size), told)
        if row is not None:
            yield done(row, old, new)

    return lambda batches: _batches(rows(batches))


def _parts(edges: DataFrame, blocks: int) -> int:
    """Few blocks a part, however many there are."""
    return min(blocks, max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks // 4)))


def first(edges: DataFrame, n: int, blocks: int, log_size: int) -> DataFrame:
    """Blocks before the first round, of distinct edges (src, dst)."""
    dealt = edges.filter("src != dst").selectExpr(f"dst % {blocks} AS block", f"src % {blocks} AS to", f"src div {blocks} AS s", f"dst div {blocks} AS d")
    every = edges.sparkSession.range(blocks).select(F.col("id").alias("block"), *(F.lit(-1).cast("long").alias(c) for c in ("to", "s", "d")))
    return dealt.unionAll(every).repartition(_parts(edges, blocks), "block").sortWithinPartitions("block", "to", "s").mapInArrow(begin(n, blocks, log_size), ROW)


def after(state: DataFrame, blocks: int, log_size: int) -> DataFrame:
    """Blocks after one more round."""
    dealt = state.mapInArrow(send(log_size), ROW).repartition(_parts(state, blocks), "block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(hear(log_size), ROW)

"""How often each number stands in columns of tables, with little to shuffle.

A task counts the values of its own rows and sorts them. What it hands on, for each column and bucket of values, is one block of
bytes: the differences between neighbouring values and the counts less one, as wide as the largest needs, compressed. Blocks of a
bucket meet in one place, where they are merged. Values that are close lie in one bucket, so that differences are small. For
that, reals that are hundredths, as money is, are packed as whole numbers of these: apart in their last bits, they lie close there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType

#: Kinds of values, and the column of the result that holds them. Zeros of both signs are two values, NaNs are one.
KINDS = {"bigint": "number", "double": "real", "timestamp_ntz": "moment"}
BUCKETS_BITS, RUN_BITS = 10, 10
HELD = 8_000_000  # values that a task keeps before it counts them
BLOCKS = "bucket int, member int, n int, first long, wide int, often int, block binary"
COUNTED = "g int, number long, real double, moment timestamp_ntz, cnt long"


def _bits(column: pa.Array) -> np.ndarray:
    """The values that aren't null as 64-bit integers, alike just where the values are."""
    column = column.drop_null()
    if pa.types.is_floating(column.type):
        x = column.to_numpy(zero_copy_only=False)
        return np.where(np.isnan(x), np.nan, x).view(np.int64)
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def _hundredths(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of these reals are the quotient of a whole number by 100, and those numbers."""
    x = bits.view(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        n = np.rint(x * 100)
        held = (np.abs(n) < 2**53) & (n / 100 == x) & (bits != np.iinfo(np.int64).min)  # not the zero that has a sign
    return held, n[held].astype(np.int64)


def _bucket(values: np.ndarray) -> np.ndarray:
    return (((values >> RUN_BITS).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS_BITS)).astype(np.int16)


def _planes(values: np.ndarray) -> tuple[int, bytes]:
    """Bytes that the largest value needs, and all first bytes, all second ones and so on."""
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return width, np.ascontiguousarray(values).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplaned(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1).view(np.int64)


def _blocks(values: np.ndarray, member: int) -> list[tuple]:
    found, often = np.unique(values, return_counts=True)
    place = _bucket(found)
    order = np.argsort(place, kind="stable")  # values stay in order within buckets
    found, often, place = found[order], often[order], place[order]
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(found)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        wide, steps = _planes(np.diff(found[a:b]).view(np.uint64))
        most, counts = _planes(often[a:b] - 1)
        raw = steps + counts
        short = pa.compress(raw, "zstd", asbytes=True) if len(raw) > 32 else raw
        out.append((int(place[a]), member, b - a, int(found[a]), wide, most, short if len(short) < len(raw) else raw))
    return out


def _values(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """The values of a block and their counts."""
    n, edge = r["n"], (r["n"] - 1) * r["wide"]
    size, raw = edge + r["n"] * r["often"], r["block"]
    if len(raw) < size:
        raw = pa.decompress(raw, size, "zstd", asbytes=True)
    steps = _unplaned(raw[:edge], n - 1, r["wide"])
    return np.cumsum(np.concatenate([[r["first"]], steps]).astype(np.int64)), _unplaned(raw[edge:], n, r["often"]) + 1


def _packer(members: list[int], kinds: list[str]):
    """Blocks of 2 * member hold values, those of 2 * member + 1 hundredths."""
    schema = pa.schema([("bucket", pa.int32()), ("member", pa.int32()), ("n", pa.int32()), ("first", pa.int64()), ("wide", pa.int32()), ("often", pa.int32()), ("block", pa.binary())])

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for member, kind, parts in zip(members, kinds, held):
            values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            parts.clear()
            packed = [(values, 2 * member)]
            if kind == "double":
                short, numbers = _hundredths(values)
                packed = [(values[~short], 2 * member), (numbers, 2 * member + 1)]
            for some, place in packed:
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*_blocks(some, place)), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [[] for _ in members], 0
        for batch in batches:
            for parts, column in zip(held, batch.columns):
                parts.append(_bits(column))
            n += batch.num_rows * len(members)
            if n >= HELD:
                yield from flush(held)
                n = 0
        yield from flush(held)

    return run


def _merger(groups: list[list[int]], kinds: list[str]):
    def merge(table: pa.Table) -> pa.Table:
        found: dict[int, list] = {}
        kind: dict[int, str] = {}
        for r in table.to_pylist():
            values, counts = _values(r)
            member, short = divmod(r["member"], 2)
            block = ((values / 100).view(np.int64) if short else values, counts)
            for g in groups[member]:
                found.setdefault(g, []).append(block)
                kind[g] = kinds[member]
        out = []
        for g, blocks in found.items():
            values, counts = (np.concatenate(x) for x in zip(*blocks))
            order = np.argsort(values, kind="stable")
            values = values[order]
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            counts, values = np.add.reduceat(counts[order], first), values[first]
            n = len(values)
            cells = {"number": pa.nulls(n, pa.int64()), "real": pa.nulls(n, pa.float64()), "moment": pa.nulls(n, pa.timestamp("us"))}
            name = KINDS[kind[g]]
            cells[name] = pa.array(values.view(np.float64) if name == "real" else values).cast(cells[name].type)
            out.append(pa.table({"g": pa.array(np.full(n, g, np.int32)), **cells, "cnt": pa.array(counts)}))
        return pa.concat_tables(out)

    return merge


def counted(tables: list[tuple[DataFrame, list[tuple[Column, str, list[int]]]]]) -> DataFrame:
    """(g, number, real, moment, cnt) of tables' columns: each with its kind and the groups in which its values are counted.

    All columns of a group have one kind, whose column of the result holds the value. Nulls aren't counted.
    """
    groups: list[list[int]] = []
    kinds: list[str] = []
    frames = []
    for rows, columns in tables:
        members = []
        for _, kind, of in columns:
            members.append(len(groups))
            groups.append(of)
            kinds.append(kind)
        cells = [c.cast(kind).alias(f"c{i}") for i, (c, kind, _) in enumerate(columns)]
        frames.append(rows.select(*cells).mapInArrow(_packer(members, [kind for _, kind, _ in columns]), StructType.fromDDL(BLOCKS)))
    blocks = reduce(DataFrame.unionByName, frames)
    # as many tasks as asked for, which Spark doesn't put together: a block's bytes don't show how many values are made of it
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(min(tasks, 1 << BUCKETS_BITS), "bucket").groupBy("bucket").applyInArrow(_merger(groups, kinds), StructType.fromDDL(COUNTED))

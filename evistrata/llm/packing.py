"""Best-two-fit packing of token sequences.

Documents are cut into pieces of at most ``capacity`` tokens.  Bins are filled greedily,
longest piece first and then the longest that fits; while a bin has a gap, its smallest piece
gives way to two unpacked pieces that fill the widened gap more tightly.

What a bin holds depends on lengths alone, and there are at most ``capacity`` of them.  So the
packing is decided on the histogram of lengths, each kind of bin with the number of times it
occurs, and costs the same for any number of documents.  The n-th piece of a length then takes
the n-th place planned for that length; pieces are numbered without any task seeing them all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistrata.llm.base import map_batches, scratch_path, texts
from evistrata.llm.tokens import library_encoder

#: The plan's search key is a length above a number within that length.
NUMBER_BITS = 44


def two_that_fit(free: np.ndarray, room: int) -> tuple[int, int]:
    """The two lengths with ``free`` pieces whose sum is largest within ``room``; zeros if there are none."""
    lengths = np.flatnonzero(free[: room + 1] > 0)
    if not len(lengths):
        return 0, 0
    most = np.minimum(lengths, room - lengths)
    at = np.searchsorted(lengths, most, "right") - 1
    alone = (at >= 0) & (lengths[np.maximum(at, 0)] == lengths) & (free[lengths] < 2)
    at = at - alone
    sums = np.where(at >= 0, lengths + lengths[np.maximum(at, 0)], 0)
    best = int(sums.argmax())
    return (int(lengths[best]), int(lengths[at[best]])) if sums[best] else (0, 0)


def fill(free: np.ndarray, capacity: int) -> list[int]:
    """One bin from the pieces that are ``free`` (number by length); they are taken out of it."""
    bin_: list[int] = []
    gap = capacity
    while gap:
        fitting = np.flatnonzero(free[: gap + 1] > 0)
        if not len(fitting):
            break
        length = int(fitting[-1])
        times = min(int(free[length]), gap // length)
        bin_ += [length] * times
        free[length] -= times
        gap -= length * times
    while gap and len(bin_) > 1:
        smallest = bin_[-1]
        long, short = two_that_fit(free, gap + smallest)
        if long + short <= smallest:
            break
        bin_.pop()
        free[smallest] += 1
        for length in (long, short):
            free[length] -= 1
        bin_ = sorted([*bin_, long, short], reverse=True)
        gap += smallest - long - short
    return bin_


@dataclass
class Plan:
    """Places by length: the ``number`` of the first piece, ``per_bin`` pieces side by side from
    ``offset`` in each bin from ``bin`` on."""

    keys: np.ndarray
    number: np.ndarray
    per_bin: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of the pieces with these numbers within their lengths."""
        at = np.searchsorted(self.keys, (lengths.astype(np.int64) << NUMBER_BITS) | numbers, "right") - 1
        beyond, inside = np.divmod(numbers - self.number[at], self.per_bin[at])
        return self.bin[at] + beyond, self.offset[at] + inside * lengths


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Decide all bins from the number of pieces of each length."""
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError("lengths must be from 1 to the capacity")
    counts = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        counts[length] = count
    planned = np.zeros(capacity + 1, np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    bins = 0
    while counts.any():
        lengths, uses = np.unique(fill(counts.copy(), capacity), return_counts=True)
        times = int((counts[lengths] // uses).min())
        offset = 0
        for length, use in zip(lengths[::-1].tolist(), uses[::-1].tolist()):
            rows.append((length, int(planned[length]), use, bins, offset))
            planned[length] += use * times
            offset += use * length
        counts[lengths] -= uses * times
        bins += times
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan((columns[0] << NUMBER_BITS) | columns[1], *columns[1:], bins)


def cut(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of every whole text: ``block`` (the task), ``doc_id``, ``piece``, ``start``,
    ``length``, ``number`` (of pieces as long in the block before it) and ``ids`` (unsigned
    little-endian 32-bit)."""
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make():
        encode, block = library_encoder(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)

        def work(batch):
            ids, sizes = encode(batch.column("text").to_pylist())
            out: dict[str, list] = {name: [] for name in ("doc_id", "piece", "start", "length", "number", "ids")}
            at = 0
            for doc_id, size in zip(batch.column("doc_id").to_pylist(), sizes.tolist()):
                whole = np.append(ids[at : at + size], end_id).astype("<u4")
                at += size
                for start in range(0, size + 1, capacity):
                    part = whole[start : start + capacity]
                    row = (doc_id, start // capacity, start, len(part), int(seen[len(part)]), part.tobytes())
                    for name, value in zip(out, row):
                        out[name].append(value)
                    seen[len(part)] += 1
            return {"block": [block] * len(out["piece"]), **out}

        return work

    return map_batches(rows, make, f"block int, doc_id {kind}, piece int, start long, length long, number long, ids binary")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    capacity: int = 4096,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Where each piece of each document goes.

    Returns ``doc_id``, ``piece``, ``start``, ``length``, ``sequence_id`` and ``offset``, and
    what ``carry`` computes from a piece's ``ids`` before rows move (default: the ids).

    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone.  Only
    documents over ``capacity`` are cut.  Repeated rows are packed each.  Pieces of equal
    length are interchangeable and go in the order of task and row.  The pieces are written
    to the shared folder first: their numbers hold only as long as nothing is computed anew.
    """
    spark = docs.sparkSession
    carry = {"ids": F.col("ids")} if carry is None else carry
    path = scratch_path(spark, "pieces")
    pieces = cut(docs, tokenizer_path, end_id, capacity)
    pieces.write.option("compression", "zstd").parquet(path)
    pieces = spark.read.schema(pieces.schema).parquet(path)

    per_block = pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("pieces"))
    histogram = {int(row["length"]): int(row["pieces"]) for row in per_block.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()}
    decided = plan(histogram, capacity)
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_block.select("length", "block", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)).alias("base"))
    narrow = pieces.select("block", "doc_id", "piece", "start", "length", "number", *[column.alias(name) for name, column in carry.items()])
    numbered = narrow.join(bases, ["length", "block"])

    kept = [field for field in narrow.schema if field.name in ("doc_id", "piece", "start", "length") or field.name in carry]
    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in kept) + ", sequence_id long, offset long"

    def make():
        def work(batch):
            lengths, numbers = (batch.column(name).to_numpy() for name in ("length", "number"))
            sequence, offset = decided.place(lengths, numbers + batch.column("base").to_numpy())
            return {field.name: batch.column(field.name) for field in kept} | {"sequence_id": sequence, "offset": offset}

        return work

    return map_batches(numbered, make, schema)

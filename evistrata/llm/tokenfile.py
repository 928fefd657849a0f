"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code.

A value takes one to four bytes.  Two bits per value, four values to a control byte, say how
many; control bytes stand apart from the data bytes, so that a reader looks up a control byte
in a table and gathers four values at once.  Ids are replaced by their rank by frequency over
the whole corpus first, which makes frequent tokens one byte long.

A corpus is a folder with ``dictionary`` (rank to id) and ``shards``, both Parquet, so that
any store Spark writes to will do and a lost task leaves no half file.  A row of ``shards``
is a document: ``shard``, ``doc_id``, ``start_in_shard``, ``n_tokens``, ``control``, ``data``.
Shards and the rows in them ascend by ``doc_id``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evistrata.llm.base import map_batches, remove, scratch_path, texts
from evistrata.llm.tokens import library_encoder, vocabulary_size

#: Bytes of each of the four values behind a control byte, and of all four.
WIDTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
TOTALS = WIDTHS.sum(axis=1)


def _shuffles() -> tuple[np.ndarray, np.ndarray]:
    """Per control byte: where each of the 16 bytes of four values stands, and which of them count."""
    firsts = np.cumsum(WIDTHS, axis=1) - WIDTHS
    inside = np.arange(4)
    real = inside < WIDTHS[:, :, None]
    return np.where(real, firsts[:, :, None] + inside, 0).reshape(256, 16), np.where(real, 255, 0).astype(np.uint8).reshape(256, 16)


SHUFFLES, MASKS = _shuffles()


def pack_rows(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of all rows, and how many of each a row has.

    ``values`` holds the unsigned 32-bit values of all rows end to end; a row starts a control
    byte of its own.
    """
    widest = 4 if len(values) and values.max() > 0xFFFF else 2
    values = np.ascontiguousarray(values, f"<u{widest}")
    widths = 1 + (values > 0xFF).astype(np.uint8)
    if widest == 4:
        widths += (values > 0xFFFF).astype(np.uint8) + (values > 0xFFFFFF)
    groups = -(-lengths // 4)
    codes = np.zeros(4 * int(groups.sum()), np.uint8)
    ends = np.cumsum(lengths)
    codes[np.arange(len(values)) + np.repeat(4 * np.cumsum(groups) - 4 * groups - ends + lengths, lengths)] = widths - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = values.view(np.uint8).reshape(-1, widest)[np.arange(widest, dtype=np.uint8) < widths[:, None]]
    before = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
    return control.astype(np.uint8), data, groups, before[ends] - before[ends - lengths]


def unpack_rows(control: np.ndarray, data: np.ndarray, groups: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The values of all rows end to end, by table lookup.

    A row has ``groups`` control bytes, ``lengths`` values, and its data bytes from ``starts``
    on.  Its last control byte may speak of up to three one-byte values that are not there.
    """
    stock = np.zeros(len(data) + 4, np.uint8)
    stock[: len(data)] = data
    totals = TOTALS[control]
    place = np.cumsum(totals) - totals
    ends = np.cumsum(groups)
    some = groups > 0
    place += np.repeat(starts[some] - place[(ends - groups)[some]], groups[some])
    found = stock[np.minimum(SHUFFLES[control] + place[:, None], len(data) + 3)]
    found &= MASKS[control]
    real = np.ones(4 * len(control), bool)
    spare = 4 * groups - lengths
    for back in (1, 2, 3):
        real[4 * ends[spare >= back] - back] = False
    return found.view("<u4").ravel()[real]


def binary_rows(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of ``sizes`` bytes cut from ``data`` without a copy per row."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, end to end, and where each row starts; the last entry is the end."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return whole, at - at[0]


def _tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, width: str) -> DataFrame:
    """Ids per row as bytes, and with the first row of each batch the counts of the batch's ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        encode = library_encoder(tokenizer_path)

        def work(batch):
            ids, lengths = encode(batch.column("text").to_pylist())
            whole = np.insert(ids, np.cumsum(lengths), end_id).astype(width)
            counts = np.bincount(whole)
            seen = np.flatnonzero(counts)
            return {
                "doc_id": batch.column("doc_id"),
                "n_tokens": lengths + 1,
                "ids": binary_rows(whole.view(np.uint8), (lengths + 1) * whole.itemsize),
                "seen": [seen] + [None] * (len(lengths) - 1),
                "times": [counts[seen]] + [None] * (len(lengths) - 1),
            }

        return work

    return map_batches(docs, make, f"doc_id {kind}, n_tokens long, ids binary, seen array<int>, times array<long>")


def write_corpus(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Encode every whole text, append ``end_id`` to each and write the corpus to ``path``.

    Null and empty texts are ``end_id`` alone.  Null ids come first; rows that repeat an id
    stay next to each other, ordered by content.  An empty table gives an empty corpus.

    Two passes: the ids are kept in the shared folder while their frequencies are
    counted, then sorted by ``doc_id`` across the shards, ranked and written.  Only the
    dictionary, at most one row per token of the vocabulary, passes through the driver.
    """
    spark = docs.sparkSession
    kept = scratch_path(spark, "token-ids")
    width = "<u2" if vocabulary_size(tokenizer_path) <= 1 << 16 and end_id < 1 << 16 else "<u4"
    staged = _tokenise(texts(docs), tokenizer_path, end_id, width)
    staged.write.option("compression", "zstd").parquet(kept)
    staged = spark.read.schema(staged.schema).parquet(kept)

    counts = (
        staged.filter(F.col("seen").isNotNull())
        .select(F.explode(F.arrays_zip("seen", "times")).alias("pair"))
        .groupBy(F.col("pair.seen").alias("token_id")).agg(F.sum("pair.times").alias("times"))
    )
    ranked = [(int(row.token_id), int(row.times)) for row in counts.orderBy(F.desc("times"), "token_id").collect()]
    spark.createDataFrame(
        [(rank, token, times) for rank, (token, times) in enumerate(ranked)], "rank int, token_id int, times long"
    ).coalesce(1).write.parquet(f"{path}/dictionary")
    rank_of = np.zeros(max((token for token, _ in ranked), default=0) + 1, np.uint32)
    rank_of[[token for token, _ in ranked]] = np.arange(len(ranked))

    def make():
        shard, total = TaskContext.get().partitionId(), 0

        def work(batch):
            nonlocal total
            lengths = batch.column("n_tokens").to_numpy()
            control, data, groups, sizes = pack_rows(rank_of[rows_of(batch.column("ids"))[0].view(width)], lengths)
            ends = total + np.cumsum(lengths)
            total = int(ends[-1])
            return {
                "shard": [shard] * len(lengths),
                "doc_id": batch.column("doc_id"),
                "start_in_shard": ends - lengths,
                "n_tokens": lengths,
                "control": binary_rows(control, groups),
                "data": binary_rows(data, sizes),
            }

        return work

    kind = staged.schema["doc_id"].dataType.simpleString()
    ordered = staged.select("doc_id", "n_tokens", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    schema = f"shard int, doc_id {kind}, start_in_shard long, n_tokens long, control binary, data binary"
    map_batches(ordered, make, schema).write.option("compression", "zstd").parquet(f"{path}/shards")
    remove(spark, kept)


def read_corpus(spark: SparkSession, path: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id``, ``start`` (ids of all rows before it), ``n_tokens`` and, decoded from the
    files, ``ids`` (unsigned little-endian 32-bit ids, as bytes) per document.

    ``carry`` names columns computed from ``ids`` to be returned in its place; they are worked
    out before rows move.  Starts come from one sum per shard; the window runs over these only.
    """
    carry = {"ids": F.col("ids")} if carry is None else carry
    dictionary = spark.read.parquet(f"{path}/dictionary").orderBy("rank").collect()
    id_of = np.array([row.token_id for row in dictionary], "<u4")
    shards = spark.read.parquet(f"{path}/shards")
    kind = shards.schema["doc_id"].dataType.simpleString()

    def make():
        def work(batch):
            lengths = batch.column("n_tokens").to_numpy()
            (control, firsts), (data, starts) = rows_of(batch.column("control")), rows_of(batch.column("data"))
            ids = id_of[unpack_rows(control, data, np.diff(firsts), starts[:-1], lengths)]
            return {
                "shard": batch.column("shard"), "doc_id": batch.column("doc_id"), "start_in_shard": batch.column("start_in_shard"),
                "n_tokens": batch.column("n_tokens"), "ids": binary_rows(ids.view(np.uint8), 4 * lengths),
            }

        return work

    decoded = map_batches(shards, make, f"shard int, doc_id {kind}, start_in_shard long, n_tokens long, ids binary")
    decoded = decoded.select("shard", "doc_id", "start_in_shard", "n_tokens", *[column.alias(name) for name, column in carry.items()])
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = shards.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    bases = sums.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    start = (F.col("base") + F.col("start_in_shard")).alias("start")
    return decoded.join(bases, "shard").select("doc_id", start, "n_tokens", *carry)

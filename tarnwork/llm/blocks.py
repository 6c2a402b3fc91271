"""Documents in blocks, and the exchange of compact runs between blocks and hash buckets.

Documents are packed, about ``BLOCK`` bytes of text to a row, and checkpointed by block, so that
later passes read them in place and a lost executor costs no recomputation. What blocks must learn
of each other goes through buckets: a block sends each bucket one sorted, delta-coded run, the
bucket combines the runs and answers each block with what concerns it. A key that sits in a third
of all documents is one entry for each block, so no key makes a bucket large.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.bytesops import U64, arrow_bytes, give_back, pieces
from tarnwork.llm.common import cut, documents, partitions, small_batches

BLOCK = 3_000_000
#: Entries that a bucket should hold about.
ENTRIES = 600_000
#: Stands for a null doc_id: after all others.
LAST = np.int64(2**63 - 1)


_squeeze, _unsqueeze = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(data: bytes) -> bytes:
    return _squeeze.compress(data)


def unsqueeze(data: bytes) -> bytes:
    return _unsqueeze.decompress(data)


def put_ints(*columns: tuple[np.ndarray, bool], tail: bytes = b"") -> bytes:
    """Integer columns, each marked as ascending or not, and other bytes, in few bytes."""
    heads, planes = [struct.pack("<B", len(columns))], []
    for values, ascending in columns:
        v = values.astype(U64)
        if ascending and len(v):
            v = np.diff(v, prepend=U64(0))
        width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
        planes.append(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
        heads.append(struct.pack("<IBB", len(v), width, ascending))
    return b"".join(heads) + squeeze(b"".join([*planes, tail]))


def get_ints(data: bytes, tail: bool = False) -> list:
    """The columns, and with ``tail`` the other bytes after them."""
    kinds = [struct.unpack_from("<IBB", data, 1 + 6 * k) for k in range(data[0])]
    body, at, out = unsqueeze(data[1 + 6 * len(kinds) :]), 0, []
    for n, width, ascending in kinds:
        v = np.zeros((n, 8), np.uint8)
        v[:, :width] = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        v = v.reshape(-1).view(U64)
        out.append(np.cumsum(v) if ascending else v)
    return [*out, body[at:]] if tail else out


class Block:
    """Some documents: flat text bytes, offsets, and doc_ids with LAST for null."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, ids: np.ndarray):
        self.flat, self.offsets, self.ids = flat, offsets, ids

    def dump(self) -> tuple[bytes, bytes]:
        return put_ints((self.offsets, True), (self.ids, False)), zstandard.ZstdCompressor(level=3).compress(self.flat.tobytes())

    @classmethod
    def load(cls, head: bytes, text: bytes) -> Block:
        offsets, ids = (x.astype(np.int64) for x in (get_ints(head)[0], get_ints(head)[1].view(np.int64)))
        size = int(offsets[-1])
        flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(text, max_output_size=size), np.uint8) if size else np.zeros(0, np.uint8)
        return cls(flat, offsets, ids)

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.ids == LAST)


def pack(docs: DataFrame, block_bytes: int = BLOCK, carry: bool = False) -> DataFrame:
    """Rows (block, size, head, text), partitioned by block and checkpointed.

    ``carry`` adds the documents' other columns, of any name and type, as a packed table.
    """
    small_batches(docs.sparkSession)
    rows = documents(docs)
    if carry:
        # by place, so that no name can clash
        rest = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text"))]
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.col("text").isNull().alias("_"), *rest).alias("_rest"))

    def batches(it):
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        for batch in it:
            flat, offsets = arrow_bytes(batch.column("text"))
            ids = batch.column("doc_id").fill_null(int(LAST)).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in pieces(offsets, block_bytes):
                b = Block(flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ids[lo:hi])
                head, text = b.dump()
                row = {"block": pa.array([(part << 24) + serial]), "size": pa.array([len(b.flat)]), "head": pa.array([head], pa.binary()), "text": pa.array([text], pa.binary())}
                if carry:
                    row["rest"] = pa.array([_to_ipc(batch.column("_rest").slice(lo, hi - lo))], pa.binary())
                yield pa.RecordBatch.from_pydict(row)
                serial += 1
            give_back()

    packed = rows.mapInArrow(batches, "block long, size long, head binary, text binary" + ", rest binary" * carry)
    return cut(packed.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block"), placed=True)


def _to_ipc(column: pa.StructArray) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_struct_array(pa.concat_arrays([column]))
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def rest_columns(data: bytes) -> list[pa.Array]:
    """Whether the text was null, and the columns that ``pack`` carried, in their order."""
    return pa.ipc.open_stream(data).read_next_batch().columns


def total_size(packed: DataFrame) -> int:
    return packed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def bucket_bits(entries: float, per: int = ENTRIES) -> int:
    return max(6, int(np.ceil(np.log2(max(1.0, entries / per)))))


def with_notes(packed: DataFrame, *notes: DataFrame) -> DataFrame:
    """Blocks with the notes (block, note) that are meant for them, one array column for each kind."""
    for k, n in enumerate(notes):
        if n.columns != ["block", f"notes{k}"]:
            n = gather(n).withColumnRenamed("notes", f"notes{k}")
        packed = packed.join(n, "block", "left")
    return packed


def gather(notes: DataFrame) -> DataFrame:
    return notes.groupBy("block").agg(F.collect_list("note").alias("notes"))


def each_block(packed: DataFrame, f: Callable, kinds: int, schema: str) -> DataFrame:
    """Maps ``f(block number, Block, [notes of each kind]) -> iterable of RecordBatch`` over the blocks."""

    def batches(it):
        for batch in it:
            for i in range(batch.num_rows):
                b = Block.load(batch.column("head")[i].as_py(), batch.column("text")[i].as_py())
                if "rest" in batch.schema.names:
                    b.rest = batch.column("rest")[i].as_py()
                yield from f(batch.column("block")[i].as_py(), b, [batch.column(f"notes{k}")[i].as_py() or [] for k in range(kinds)])
            give_back()

    return packed.mapInArrow(batches, schema)


def runs_out(block: int, bucket: np.ndarray, columns: list[tuple[np.ndarray, bool]]):
    """One run for each bucket; the entries come sorted by bucket."""
    if not len(bucket):
        return
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    stop = np.append(start[1:], len(bucket))
    runs = [put_ints(*[(c[a:b], up) for c, up in columns]) for a, b in zip(start, stop)]
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[start].astype(np.int64)), "block": pa.array(np.full(len(start), block, np.int64)), "run": pa.array(runs, pa.binary())})


RUNS = "bucket long, block long, run binary"
NOTES = "block long, note binary"


def each_bucket(runs: DataFrame, f: Callable) -> DataFrame:
    """Combines each bucket's runs by ``f(bucket, list of runs) -> list of notes or None``, a note for each run's block."""

    def combine(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        notes = f(table.column("bucket")[0].as_py(), table.column("run").to_pylist())
        some = [(b, n) for b, n in zip(blocks, notes) if n is not None]
        give_back()
        return pa.table({"block": pa.array([b for b, _ in some], pa.int64()), "note": pa.array([n for _, n in some], pa.binary())})

    return runs.groupBy("bucket").applyInArrow(combine, NOTES)

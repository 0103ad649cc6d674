"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record is framed as in the public TFRecord layout: length (8 bytes), masked CRC-32C of the length,
payload, masked CRC-32C of the payload, all little-endian. The payload is the width of an id in bytes
(a 4-byte number) and the ids, two bytes wide where the vocabulary allows it, else four. Beside every data file lies an index of 24 bytes per record (offset, key, whether the key is
set), so that a reader can fetch any record without a scan. Files follow the ascending key.

Tasks write under a name of their own and rename at the end; the same rows give the same bytes, so a
task that runs again, after an executor was lost, replaces its file by an equal one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordstack.llm.bpe import encoder, vocabulary
from ordstack.llm.corpus import columns, read, spans
from ordstack.session import scratch_path, store

#: Reversed Castagnoli polynomial and the mask's constant: fixed values of the format.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8

FRAME = 16  # bytes around a payload: 12 before, 4 after
INDEX = np.dtype([("offset", "<u8"), ("key", "<i8"), ("has_key", "<u8")])
#: Bytes that are checked side by side, and bytes a reader holds at once.
LANE = 128
READ_BYTES = 8 << 20
END_ID = 2
WIDTHS = {2: np.dtype("<u2"), 4: np.dtype("<u4")}


def _tables() -> np.ndarray:
    """Eight tables: what a byte contributes after 0 to 3 more bytes; then what each byte of a
    checksum becomes after LANE zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> 1) ^ np.where(one & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    made = [one]
    for _ in range(3):
        made.append((made[-1] >> 8) ^ one[made[-1] & 255])
    for k in range(4):
        moved = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(LANE):
            moved = (moved >> 8) ^ one[moved & 255]
        made.append(moved)
    return np.array(made)


_TABLES = _tables()


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each of many byte strings of at least four bytes.

    Every string is padded in front to whole lanes (leading zeros don't count), all lanes are summed
    side by side, and a string's lanes are then folded from its first to its last.
    """
    if not parts:
        return np.zeros(0, dtype=np.uint32)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    lanes = -(-sizes // LANE)
    ends = np.cumsum(lanes)
    flat = np.zeros(int(ends[-1]) * LANE, dtype=np.uint8)
    joined = np.frombuffer(b"".join(parts), dtype=np.uint8)
    shift = ends * LANE - np.cumsum(sizes)  # a string's place in the padded array, less its place here
    flat[np.arange(len(joined)) + np.repeat(shift, sizes)] = joined
    first = ends * LANE - sizes
    for k in range(4):  # starting from all ones is the same as turning the first four bytes
        flat[first + k] ^= 255
    words = np.ascontiguousarray(flat.view("<u4").reshape(-1, LANE // 4).T)
    t, crc = _TABLES, np.zeros(words.shape[1], dtype=np.uint32)
    for word in words:
        x = crc ^ word
        crc = t[3][x & 255] ^ t[2][x >> 8 & 255] ^ t[1][x >> 16 & 255] ^ t[0][x >> 24]
    out = np.zeros(len(parts), dtype=np.uint32)
    starts, order = ends - lanes, np.argsort(-lanes, kind="stable")
    sorted_lanes = lanes[order]
    for k in range(int(sorted_lanes[0])):
        on = order[: np.searchsorted(-sorted_lanes, -k, side="left")]
        x = out[on]
        moved = t[4][x & 255] ^ t[5][x >> 8 & 255] ^ t[6][x >> 16 & 255] ^ t[7][x >> 24]
        out[on] = moved ^ crc[starts[on] + k]
    return ~out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    heads, bodies = masked(crc32c(lengths)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [
        b"".join((n, h.tobytes(), p, b.tobytes())) for n, h, p, b in zip(lengths, heads, payloads, bodies)
    ]


def unframed(data: bytes, offsets: list[int]) -> list[bytes]:
    """Payloads of the records at the given offsets of ``data``; raises where a checksum disagrees."""
    sizes = [int.from_bytes(data[o : o + 8], "little") for o in offsets]
    payloads = [data[o + 12 : o + 12 + n] for o, n in zip(offsets, sizes)]
    heads = masked(crc32c([data[o : o + 8] for o in offsets]))
    bodies = masked(crc32c(payloads))
    for o, n, h, b in zip(offsets, sizes, heads.tolist(), bodies.tolist()):
        head, body = data[o + 8 : o + 12], data[o + 12 + n : o + 16 + n]
        if h.to_bytes(4, "little") != head or b.to_bytes(4, "little") != body:
            raise ValueError(f"a record at {o} is damaged")
    return payloads


def packed(ids: bytes, width: int) -> bytes:
    """Payload of ids given as unsigned 32-bit numbers."""
    return width.to_bytes(4, "little") + np.frombuffer(ids, dtype="<u4").astype(WIDTHS[width]).tobytes()


def unpacked(payload: bytes) -> bytes:
    """Ids of a payload as unsigned 32-bit numbers."""
    width = int.from_bytes(payload[:4], "little")
    return np.frombuffer(payload, dtype=WIDTHS[width], offset=4).astype("<u4").tobytes()


def filesystem(uri: str):
    """File system and path of a folder that executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class Written:
    folder: str
    #: (part, records, ids) of every file, in order; one entry per file.
    parts: list[tuple[int, int, int]]


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> Written:
    """Write ``docs`` (``doc_id``, ``text``) as token records into ``folder``, in ascending ``doc_id``.

    Texts are dealt out by ranges of the key and, where many rows share one or have none, of a hash of the
    text, and sorted within; a null key comes last. Null and empty texts give the end id alone. No documents,
    no files.
    """
    docs = columns(docs, "doc_id", "text")
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        store_, root = filesystem(folder)
        enc, index, offset, n_ids, out = encoder(tokenizer), [], 0, 0, None
        temp = f"{root}/.part-{part:06d}-{attempt}"
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        for batch in batches:
            for lo, hi in spans(batch.column(1)):
                piece = batch.slice(lo, hi - lo)
                if out is None:
                    store_.create_dir(root, recursive=True)
                    out = store_.open_output_stream(temp)
                texts = [ids + end for ids in enc.encode(piece.column(1).to_pylist())]
                n_ids += sum(map(len, texts)) // 4
                payloads = [packed(ids, width) for ids in texts]
                sizes = np.fromiter(map(len, payloads), dtype=np.int64, count=len(payloads))
                rows = np.zeros(len(payloads), dtype=INDEX)
                rows["offset"] = offset + np.concatenate([[0], np.cumsum(sizes + FRAME)[:-1]])
                rows["key"] = piece.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                rows["has_key"] = piece.column(0).is_valid().to_numpy(zero_copy_only=False)
                index.append(rows.tobytes())
                out.write(b"".join(frames(payloads)))
                offset += int((sizes + FRAME).sum())
        if out is None:
            return
        out.close()
        with store_.open_output_stream(f"{temp}.index") as at:
            at.write(b"".join(index))
        store_.move(temp, f"{root}/part-{part:06d}.rec")
        store_.move(f"{temp}.index", f"{root}/part-{part:06d}.idx")
        n = sum(map(len, index)) // INDEX.itemsize
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([n_ids], pa.int64())],
            names=["part", "n_records", "n_ids"],
        )

    summary = store(ranged.mapInArrow(run, "part int, n_records long, n_ids long"), "record-files")
    return Written(folder, sorted(tuple(r) for r in summary.collect()))


def records(spark: SparkSession, written: Written) -> DataFrame:
    """Read the files back: ``doc_id``, ``start`` (ids in all records before), ``n_tokens`` and
    ``ids_crc32`` of every record. Files go to one task each and are read in bounded steps."""
    before, files = 0, []
    for part, _, n_ids in written.parts:
        files.append((part, before))
        before += n_ids
    folder = written.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_, root = filesystem(folder)
        for batch in batches:
            for part, start in zip(*(c.to_pylist() for c in batch.columns)):
                with store_.open_input_file(f"{root}/part-{part:06d}.idx") as f:
                    index = np.frombuffer(f.read(), dtype=INDEX)
                with store_.open_input_file(f"{root}/part-{part:06d}.rec") as f:
                    edges = np.append(index["offset"], f.size()).astype(np.int64)
                    lo = 0
                    while lo < len(index):
                        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + READ_BYTES, side="right")) - 1)
                        f.seek(int(edges[lo]))
                        data = f.read(int(edges[hi] - edges[lo]))
                        found = [unpacked(x) for x in unframed(data, (edges[lo:hi] - edges[lo]).tolist())]
                        n = np.array([len(x) // 4 for x in found], dtype=np.int64)
                        begin = start + np.concatenate([[0], np.cumsum(n)[:-1]])
                        rows = index[lo:hi]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(rows["key"].astype(np.int64), mask=rows["has_key"] == 0),
                                pa.array(begin.astype(np.int64)),
                                pa.array(n),
                                pa.array([zlib.crc32(x) for x in found], pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        start += int(n.sum())
                        lo = hi

    listed = spark.createDataFrame(files, "part int, start long")
    dealt = listed.repartitionByRange(len(files), "part") if files else listed
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(folder: str, part: int, positions: list[int]) -> list[np.ndarray]:
    """Ids of single records of a file by position, through the index: what a shuffled reader does."""
    store_, root = filesystem(folder)
    with store_.open_input_file(f"{root}/part-{part:06d}.idx") as f:
        index = np.frombuffer(f.read(), dtype=INDEX)
    out = []
    with store_.open_input_file(f"{root}/part-{part:06d}.rec") as f:
        for p in positions:
            f.seek(int(index["offset"][p]))
            size = int.from_bytes(f.read(8), "little")
            f.seek(int(index["offset"][p]))
            out.append(np.frombuffer(unpacked(unframed(f.read(size + FRAME), [0])[0]), dtype="<u4"))
    return out


def op3_binary_records(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token records of all documents, written to the shared folder and read back from the files."""
    folder = scratch_path(spark, "records")
    return records(spark, write(read(spark, sf_dir), path or vocabulary(), folder))

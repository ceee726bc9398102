"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

Texts are encoded once, in chunks between blanks (this vocabulary drops white
space, so chunks encode independently and repeat often), and kept as a table of
raw ids. Each task counts the ids it makes, and the counts are summed; ids become ranks, the most
frequent first, so that most need one byte. Rows are range-partitioned by
doc_id and sorted, and each partition writes files of bounded size. Offsets come
from per-file counts, not from a global pass over rows.

File layout, little-endian: ``PTOK``, u32 documents, u64 ids; i64 doc_id, u8
null flag and u32 count for each document; then one control byte per four ids
(two bits each: bytes of the rank less one), then the ranks' bytes. ``ranks.bin``
holds the id of each rank as u32. Files are written to a temporary name and
renamed, so a repeated task leaves the same file.

Files go through ``pyarrow.fs`` (local, shared and object stores by URI) and are
read with Spark's ``binaryFile`` source.

Defined results: a null or empty text has the end id alone; null doc_ids come
first; rows with equal doc_id stay apart, ordered by their ids; an empty table
gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import gc
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.store import Staged, large, new_path

#: Chunks of each of the two generations a worker remembers; a full young one becomes the old one.
MAX_CHUNKS = 300_000
MAX_CHUNK_CHARS = 64
#: Ids after which a file is closed (a longer document has a file of its own).
SHARD_IDS = 4_000_000

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) <= code[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The numbers again: lengths by table lookup, then one gather per byte position."""
    lengths = _LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    out = data[at].astype(np.uint32) if n else np.empty(0, np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        out[more] |= data[at[more] + k].astype(np.uint32) << (8 * k)
    return out


class Chunks(dict):
    """Ids of chunks between blanks by one tokenizer file, found on first use.

    A chunk of plain letters, perhaps with marks behind it, is one or two words to
    this vocabulary's splitter whatever surrounds it: they go to the library's merge
    model one by one. Any other chunk goes through the library's whole pipeline, and
    so does every whole text where the file splits in another way.
    """

    def __init__(self, path: str, width: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # this class remembers more, and only words it has not met come here
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.raw = [x.tobytes() for x in np.arange(size, dtype=width)]
        self.older: dict[str, bytes] = {}
        self.simple = self._splits_words()
        self.plain = re.compile("([A-Za-zÀ-ÖØ-Ýà-öø-ÿ]+)([.,;:!?|#$%&*-]+)").fullmatch
        #: How byte-level models write a byte: printable ones as themselves, the rest from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in shown]
        letter = {x: chr(x) for x in shown} | {x: chr(256 + i) for i, x in enumerate(rest)}
        self.spelt = {c: "".join(letter[x] for x in chr(c).encode("utf-8")) for c in range(128, 256)}

    def _splits_words(self) -> bool:
        """Whether this file lower-cases, composes and splits into words, runs of marks and single digits."""
        import json

        own = json.loads(self.tokenizer.to_str())
        kinds = lambda x: sorted(y["type"] for y in ((own.get(x) or {}).get("normalizers") or (own.get(x) or {}).get("pretokenizers") or []))
        return kinds("normalizer") == ["Lowercase", "NFC", "Replace"] and kinds("pre_tokenizer") == ["ByteLevel", "Split"]

    def __missing__(self, chunk: str) -> bytes:
        got = self.older.get(chunk)
        if got is None:
            raw, word = self.raw, self.simple and chunk.isalpha()
            if word and not chunk.isascii():
                word = max(chunk) <= "\xff"
            if word:
                if chunk.islower():
                    got = b"".join([raw[t.id] for t in self.model.tokenize(chunk.translate(self.spelt))])
                else:
                    got = self[chunk.lower()]
            elif self.simple and (m := self.plain(chunk)):
                got = self[m[1]] + self[m[2]]
            else:
                got = b"".join([raw[i] for i in self.tokenizer.encode(chunk, add_special_tokens=False).ids])
        if len(chunk) <= MAX_CHUNK_CHARS:
            if len(self) >= MAX_CHUNKS:
                self.older = dict(self)
                self.clear()
            self[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        if not self.simple:  # pieces of another file may hold blanks: nothing is cut beforehand
            return b"".join([self.raw[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def _chunks(path: str, width: str) -> Chunks:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    gc.set_threshold(500_000, 50, 1000)  # remembered chunks are acyclic; frequent collections only cost
    return large((Chunks, path, width), lambda: Chunks(path, width))


def tokenize(df: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", width: str = "<u4", size: int = 0) -> DataFrame:
    """Rows (doc_id, raw, counts): ids of the whole text and the end id, as little-endian numbers.

    Each task ends with a row that has the 64-bit ``counts`` of its first ``size`` ids and no text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, total = _chunks(path, width), np.array([end_id], dtype=width).tobytes(), np.zeros(size, np.int64)
        names = ["doc_id", "raw", "counts"]
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                raw = [own.encode(t or "") + end for t in batch.column(1).to_pylist()]
                total += np.bincount(np.frombuffer(b"".join(raw), dtype=width), minlength=size)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.nulls(len(raw), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=names)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, raw binary, counts binary")


def count_ids(tokens: DataFrame) -> DataFrame:
    """Rows (id, n) over every document, from the tasks' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                one = np.frombuffer(cell, np.int64)
                total = one + total if len(total) else one
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return tokens.where(F.col("counts").isNotNull()).select("counts").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(uri: str, data: bytes, attempt: str) -> None:
    store, path = _fs(uri)
    with store.open_output_stream(f"{path}.{attempt}.tmp") as f:
        f.write(data)
    store.move(f"{path}.{attempt}.tmp", path)


def write_files(spark: SparkSession, df: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> tuple[str, DataFrame]:
    """Encodes every text and writes token files. Returns the folder and rows (part, shard, n_docs, n_ids)."""
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end_id + 1)
    width = "<u2" if size <= 1 << 16 else "<u4"
    folder = folder or new_path(spark, "tokens")
    raw = Staged(spark, tokenize(df, path, end_id, doc_id, text, width, size), "raw")
    counts = count_ids(raw.df).collect()  # at most one row per vocabulary entry
    order = [r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))]
    rank_of = np.zeros(size, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    store, at = _fs(folder)
    store.create_dir(at, recursive=True)
    _write(f"{folder}/ranks.bin", np.array(order, "<u4").tobytes(), "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, shard, docs, held, n = task.partitionId(), 0, [], [], 0
        rows = []

        def close() -> None:
            nonlocal shard, docs, held, n
            ids = rank_of[np.frombuffer(b"".join(held), dtype=width)]
            control, data = pack(ids)
            head = struct.pack("<4sIQ", b"PTOK", len(docs), n)
            keys = np.array([d or 0 for d, _ in docs], "<i8").tobytes() + np.array([d is None for d, _ in docs], np.uint8).tobytes() + np.array([c for _, c in docs], "<u4").tobytes()
            _write(f"{folder}/part-{part:06d}-{shard:06d}.tok", head + keys + control + data, str(task.taskAttemptId()))
            rows.append((part, shard, len(docs), n))
            shard, docs, held, n = shard + 1, [], [], 0

        step = np.dtype(width).itemsize
        for batch in batches:
            for d, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append((d, len(r) // step))
                held.append(r)
                n += len(r) // step
                if n >= SHARD_IDS:
                    close()
        if docs:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["part", "shard", "n_docs", "n_ids"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = raw.df.where(F.col("raw").isNotNull()).select("doc_id", "raw").repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.crc32("raw")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32("raw"), "raw")
    files = Staged(spark, ordered.mapInArrow(run, "part int, shard int, n_docs long, n_ids long"), "manifest")
    raw.drop()
    return folder, files.df


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (part, shard, doc_id, at, n_tokens, ids): ``at`` counts from the file's start, ``ids`` are little-endian u32."""
    ranks = spark.read.format("binaryFile").load(f"{folder}/ranks.bin").select("content").first()
    order = np.frombuffer(ranks[0] if ranks else b"", "<u4")  # an empty file is no row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                part, shard = map(int, re.search(r"part-(\d+)-(\d+)\.tok", name).groups())
                raw = np.frombuffer(cell.as_buffer(), np.uint8)
                magic, docs, n = struct.unpack_from("<4sIQ", cell.as_buffer())
                assert magic == b"PTOK", name
                ids = raw[16 : 16 + 8 * docs].view("<i8")
                null = raw[16 + 8 * docs : 16 + 9 * docs].astype(bool)
                counts = np.frombuffer(raw[16 + 9 * docs : 16 + 13 * docs].tobytes(), "<u4").astype(np.int64)
                body = raw[16 + 13 * docs :]
                control = -(-n // 4)
                tokens = order[unpack(body[:control], body[control:], n)].astype("<u4")
                ends = np.cumsum(counts)
                for at in range(0, docs, 1024):
                    to = min(docs, at + 1024)
                    low, high = (ends[at] - counts[at]), ends[to - 1]
                    offsets = np.concatenate([[0], ends[at:to] - low]) * 4
                    values = pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(np.ascontiguousarray(tokens[low:high]))])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(to - at, part, np.int32)), pa.array(np.full(to - at, shard, np.int32)), pa.array(ids[at:to], pa.int64(), mask=null[at:to]), pa.array((ends - counts)[at:to]), pa.array(counts[at:to]), values.cast(pa.binary())],
                        names=["part", "shard", "doc_id", "at", "n_tokens", "ids"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("path", "content")
    return files.mapInArrow(run, "part int, shard int, doc_id long, at long, n_tokens long, ids binary")


def starts(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Rows (part, shard, base): ids in all files before each one.

    Within a part a window; across parts a running sum over one row per partition.
    """
    from pyspark.sql import Window

    parts = sorted((r.part, r.n) for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases, total = [], 0
    for part, n in parts:
        bases.append((part, total))
        total += n
    before = spark.createDataFrame(bases, "part int, part_base long")
    w = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = manifest.select("part", "shard", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).alias("shard_base"))
    return inside.join(F.broadcast(before), "part").select("part", "shard", (F.col("part_base") + F.col("shard_base")).alias("base"))


def digests(spark: SparkSession, df: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document, from files written and read back: doc_id, start, n_tokens, ids_crc32."""
    folder, manifest = write_files(spark, df, path, end_id, doc_id, text)
    base = starts(spark, manifest)
    if manifest.count() <= 1_000_000:  # a row per file of a few MB
        base = F.broadcast(base)
    rows = read_files(spark, folder)
    return rows.join(base, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", F.crc32("ids").alias("ids_crc32"))

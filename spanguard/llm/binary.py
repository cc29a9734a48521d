"""Token files: independent zstandard frames, a document index, and a trailing seek table with a checksum for each frame.

Layout of a file (all numbers little-endian):

* data frames: ids of whole documents as unsigned 32-bit integers, about ``FRAME_IDS`` ids each, every frame on its own;
* one skippable frame (magic 0x184D2A51) with a zstandard frame of the document index: a count, then as unsigned 64-bit
  columns first id in the file and number of ids of each document;
* one skippable frame (magic 0x184D2A5E), the seek table: for each data frame compressed size, decompressed size and
  checksum (low half of xxh64 of its content), 32 bits each; one more entry for the index; then the number of entries (32
  bits), a descriptor byte (0x80: checksums) and the magic 0x8F92EAB1.

A reader takes the end of the file, then the index, then only the frames that hold the documents asked for. Files are
written below the shared folder under names of their own for each attempt of a task; only those that the stored manifest
names belong to the result, so a task can be repeated anywhere.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.taskcontext import TaskContext

from spanguard.llm import tokens
from spanguard.llm.bytetext import slices
from spanguard.llm.rows import stored
from spanguard.session import scratch

FRAME_IDS = 1 << 16
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A51, 0x184D2A5E, 0x8F92EAB1


def filesystem(path: str):
    """The file system of a path or address and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer:
    """Writes one file front to back; holds one open frame at a time and three numbers for each document."""

    def __init__(self, path: str, level: int = 1):
        import zstandard

        files, place = filesystem(path)
        files.create_dir(place.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(place, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.sizes: list[int] = []
        self.open: list[np.ndarray] = []
        self.waiting = 0

    def add(self, ids: np.ndarray) -> None:
        self.sizes.append(len(ids))
        self.open.append(ids.astype("<u4"))
        self.waiting += len(ids)
        if self.waiting >= FRAME_IDS:
            self._flush()

    def _entry(self, content: bytes, skippable: int | None = None) -> None:
        import xxhash

        frame = self.zstd.compress(content)
        if skippable is not None:
            frame = struct.pack("<II", skippable, len(frame)) + frame
        self.out.write(frame)
        self.entries.append((len(frame), 0 if skippable is not None else len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def _flush(self) -> None:
        whole = np.concatenate(self.open) if self.open else np.zeros(0, "<u4")
        for at in range(0, len(whole), FRAME_IDS * 4):  # a very long document takes several frames
            self._entry(whole[at : at + FRAME_IDS * 4].tobytes())
        self.open, self.waiting = [], 0

    def close(self) -> tuple[int, int]:
        """Number of documents and of ids."""
        self._flush()
        sizes = np.array(self.sizes, "<u8")
        self._entry(struct.pack("<Q", len(sizes)) + (np.cumsum(sizes) - sizes).astype("<u8").tobytes() + sizes.tobytes(), INDEX_MAGIC)
        body = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), 0x80, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(body)) + body)
        self.out.close()
        return len(sizes), int(sizes.sum())


class Reader:
    """Reads documents by number; decompresses the frames that hold them and checks each against the seek table."""

    def __init__(self, path: str):
        import zstandard

        files, place = filesystem(path)
        self.source, self.zstd = files.open_input_file(place), zstandard.ZstdDecompressor()
        size = self.source.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError(f"no seek table in {path}")
        table = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.begins = np.cumsum(table[:, 0]) - table[:, 0]
        self.lengths, self.sums = table[:, 0], table[:, 2]
        self.first_id = np.concatenate([[0], np.cumsum(table[:-1, 1] // 4)])
        index = self._content(count - 1, 8)
        documents = struct.unpack_from("<Q", index)[0]
        columns = np.frombuffer(index, "<u8", offset=8).astype(np.int64)
        self.starts, self.sizes = columns[:documents], columns[documents:]
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def _at(self, begin: int, length: int) -> bytes:
        self.source.seek(begin)
        return self.source.read(length)

    def _content(self, frame: int, skip: int = 0) -> bytes:
        import xxhash

        content = self.zstd.decompress(self._at(int(self.begins[frame]) + skip, int(self.lengths[frame]) - skip))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.sums[frame]:
            raise ValueError(f"checksum of frame {frame} is wrong")
        return content

    def __len__(self) -> int:
        return len(self.sizes)

    def document(self, number: int) -> np.ndarray:
        low, high = int(self.starts[number]), int(self.starts[number] + self.sizes[number])
        parts, frame = [], int(np.searchsorted(self.first_id, low, side="right")) - 1
        while low < high:
            if self.held[0] != frame:
                self.held = (frame, np.frombuffer(self._content(frame), "<u4"))
            begin = int(self.first_id[frame])
            part = self.held[1][low - begin : high - begin]
            parts.append(part)
            low, frame = low + len(part), frame + 1
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")


#: Ids that a task reads back.
READ_IDS = 1 << 22


def _written(folder: str, key: str, text: str, tokenizer: str):
    """Writes the file of a task and returns its chunks: where each starts in the file's documents, and their keys."""

    def run(batches):
        writer, path, part, first = None, "", TaskContext.get().partitionId(), 0
        for batch in slices(batches, text):
            if writer is None:
                path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.zst"
                writer = Writer(path)
            ids, bounds = tokens.encoder(tokenizer).encode(batch.column(batch.schema.get_field_index(text)))
            for low, high in zip(bounds.tolist(), bounds[1:].tolist()):
                writer.add(ids[low:high])
            keys = batch.column(batch.schema.get_field_index(key))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([path]), pa.array([first]), pa.array([int(bounds[-1])]), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), keys)],
                names=["part", "path", "first", "ids", "keys"],
            )
            first += n
        if writer:
            writer.close()

    return run


def written(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Writes all texts in ascending ``key`` and returns the stored manifest.

    A row of the manifest is a run of documents of a file (some MB of text): part, path, number of its first document in the
    file, its ids, the keys of its documents, and ``before``, the ids of all documents ahead of it. Null keys come first;
    rows with one key follow each other in the order of a hash of their text. A null text is empty and holds the end id only.
    """
    folder = folder or scratch(df.sparkSession, "tokens")
    order = [F.col(key).asc_nulls_first(), F.xxhash64(text)]
    ordered = df.select(key, text).repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = stored(ordered.mapInArrow(_written(folder, key, text, tokenizer), f"part int, path string, first long, ids long, keys array<{dict(df.dtypes)[key]}>"), "manifest")
    zero = F.lit(0).cast("long")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one sum for each written file
    files = chunks.groupBy("part").agg(F.sum("ids").alias("__ids")).select("part", F.coalesce(F.sum("__ids").over(ahead), zero).alias("__ahead"))
    inside = Window.partitionBy("part").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    places = chunks.select("part", "first", F.coalesce(F.sum("ids").over(inside), zero).alias("__inside"))
    places = places.join(F.broadcast(files), "part").select("part", "first", (F.col("__ahead") + F.col("__inside")).alias("before"))
    return chunks.join(places, ["part", "first"])


def _read(batches):
    reader, opened = None, None
    for batch in batches:
        for row in range(batch.num_rows):
            take = {n: batch.column(batch.schema.get_field_index(n))[row].as_py() for n in ("path", "first", "before")}
            keys = batch.column(batch.schema.get_field_index("keys"))[row].values
            if take["path"] != opened:  # rows of a file follow each other
                reader, opened = Reader(take["path"]), take["path"]
            start = take["before"]
            starts, sizes, sums = [], [], []
            for number in range(take["first"], take["first"] + len(keys)):
                ids = reader.document(number)
                starts.append(start)
                sizes.append(len(ids))
                sums.append(zlib.crc32(ids.tobytes()))
                start += len(ids)
            yield pa.RecordBatch.from_arrays([keys, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])


def read_back(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each document, from the files: key, ids before it, its ids and their checksum.

    The number of tasks follows the ids in the files; the manifest alone, a few bytes a document, would fit one.
    """
    kind = manifest.schema["keys"].dataType.elementType.simpleString()
    tasks = 1 + (manifest.agg(F.sum("ids")).first()[0] or 0) // READ_IDS
    runs = manifest.select("path", "first", "before", "keys").repartition(tasks, "path", "first").sortWithinPartitions("path", "first")
    return runs.mapInArrow(_read, f"key {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", key)

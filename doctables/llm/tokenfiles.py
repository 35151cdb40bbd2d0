"""Files of token ids: independent zstandard frames, a document index and a seek table at the end.

A file is a sequence of zstandard frames, so any zstandard reader can unpack it:

* data frames: ids as little-endian unsigned 32-bit integers, up to FRAME_IDS ids each;
* one skippable frame with the document index: a row (doc_id int64, -2^63 for none,
  number of ids int64) per document, zstandard-packed;
* one skippable frame with the seek table of the seekable zstandard format: packed
  size, unpacked size and the low 32 bits of XXH64 per frame (the index is the last,
  with unpacked size 0), then the number of frames, a flag byte and the magic number.

A reader takes the footer, which is the last nine bytes, then the seek table and the
index, and unpacks only the frames that hold the documents asked for.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doctables.llm.tokencount import MODEL, tokenizer
from doctables.llm.wordcache import WordCache, encode_words, portions, word_parts
from doctables.llm.work import saved

FRAME_IDS = 1 << 16  #: ids of a frame
FILE_IDS = 1 << 23  #: ids of a file, unless one document alone has more
FILE_DOCS = 1 << 18  #: documents of a file, however short they are
NO_ID = -(1 << 63)
# Fixed values of the format.
SKIPPABLE, INDEX, SEEK_END, CHECKED = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1, 0x80


class TokenFileWriter:
    """Writes one file; documents are appended in order and may span frames."""

    def __init__(self, out):
        self.out, self.packer = out, zstandard.ZstdCompressor(level=3)
        self.waiting: list[bytes] = []
        self.size, self.table, self.index = 0, [], []

    def add(self, doc_id: int, ids: bytes) -> None:
        self.index.append((doc_id, len(ids) // 4))
        view = memoryview(ids)
        while len(view):
            part = view[: FRAME_IDS * 4 - self.size]
            self.waiting.append(bytes(part))
            self.size += len(part)
            view = view[len(part) :]
            if self.size == FRAME_IDS * 4:
                self._frame()

    def _frame(self) -> None:
        raw = b"".join(self.waiting)
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.waiting, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._frame()
        index = self.packer.compress(np.array(self.index, dtype="<i8").reshape(-1, 2).tobytes())
        self.out.write(struct.pack("<II", INDEX, len(index)) + index)
        self.table.append((8 + len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        seek = b"".join(struct.pack("<III", *row) for row in self.table)
        seek += struct.pack("<IBI", len(self.table), CHECKED, SEEK_END)
        self.out.write(struct.pack("<II", SKIPPABLE, len(seek)) + seek)


class TokenFileReader:
    """Reads documents by place, unpacking only the frames that hold them and checking their sums."""

    def __init__(self, source):
        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        end = source.seek(0, 2)
        count, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_END or flags != CHECKED:
            raise ValueError("no seek table")
        self.table = np.frombuffer(self._at(end - 9 - 12 * count, 12 * count), dtype="<u4").reshape(count, 3).astype(np.int64)
        tail = end - 9 - 12 * count - 8 - int(self.table[-1, 0])
        magic, size = struct.unpack("<II", self._at(tail, 8))
        if magic != INDEX:
            raise ValueError("no document index")
        self.index = np.frombuffer(self.unpacker.decompress(self._at(tail + 8, size)), dtype="<i8").reshape(-1, 2)
        self.table = self.table[:-1]
        self.packed = np.concatenate(([0], np.cumsum(self.table[:, 0])))
        self.raw = np.concatenate(([0], np.cumsum(self.table[:, 1])))
        self.starts = np.concatenate(([0], np.cumsum(self.index[:, 1]))) * 4
        self.last: tuple[int, bytes] = (-1, b"")

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(int(place))
        return self.source.read(int(size))

    def _frame(self, k: int) -> bytes:
        if self.last[0] != k:
            raw = self.unpacker.decompress(self._at(self.packed[k], self.table[k, 0]))
            if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, raw)
        return self.last[1]

    def parts(self, place: int) -> Iterator[bytes]:
        """The ids of the document at this place, in pieces of a frame at most."""
        start, end = int(self.starts[place]), int(self.starts[place + 1])
        k = int(np.searchsorted(self.raw, start, "right")) - 1
        while start < end:
            stop = min(end, int(self.raw[k + 1]))
            yield self._frame(k)[start - int(self.raw[k]) : stop - int(self.raw[k])]
            start, k = stop, k + 1

    def ids(self, place: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.parts(place)), dtype="<u4")


def file_system(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if folder.startswith("/"):
        return pyarrow.fs.LocalFileSystem(), folder
    return pyarrow.fs.FileSystem.from_uri(folder.replace("file:/", "file:///") if folder.startswith("file:/") and not folder.startswith("file://") else folder)


@lru_cache(maxsize=4)
def _ids(path: str) -> WordCache:
    model = tokenizer(path)
    return WordCache(lambda words: encode_words(model, words), word_parts)


def words(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, in small letters where that gives the same ids.

    The tokenizer makes letters small itself, but only after it has joined combining
    marks and looked for special strings, so only ASCII texts without those qualify.
    """
    return (text.lower() if text.isascii() and b"<|" not in text else text).split()


def encoded(texts: Iterable[bytes | None], model: str = MODEL, end: int | None = None) -> Iterator[bytes]:
    """Ids of each whole text (UTF-8) as little-endian unsigned 32-bit integers; see tokencount for the safe split."""
    cache = _ids(public_tokenizers.path(model))
    last = b"" if end is None else struct.pack("<I", end)
    plain = [t or b"" for t in texts]
    for first, stop in portions(map(len, plain)):
        split = [words(t) for t in plain[first:stop]]
        for ids in cache.lists(split):
            yield b"".join(ids) + last


def write_token_files(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end: int = 1,
    model: str = MODEL, partitions: int | None = None,
) -> DataFrame:
    """Write the ids of all documents in ascending id order; returns the list of files, in order.

    Ranges of ids go to tasks, which sort them and write files of bounded size. A
    file gets its final name only when it is whole, and a repeated task writes its
    own files, of which the list names one set: lost executors leave spare files but
    no wrong ones. Rows of equal id follow the order of their texts; rows without id
    come first; NULL text counts as empty, so it holds the end id alone. The list
    has path, part, file, n_docs, n_ids and first_id, the number of ids before it.
    """
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text")
    )
    ranged = rows.repartitionByRange(parts, "id", F.xxhash64("text")).sortWithinPartitions(
        "id", F.xxhash64("text"), "text"
    )

    listing = pa.schema(
        [("path", pa.string()), ("part", pa.int32()), ("file", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, base = file_system(folder)
        part = TaskContext.get().partitionId()
        done, writer, count = [], None, 0

        def finish() -> None:
            nonlocal writer
            writer.close()
            writer.out.close()
            system.move(f"{name}.part", name)
            done.append((name, part, len(done), len(writer.index), count))
            writer = None

        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()  # as they came, not as Python strings
            for doc_id, ids in zip(batch.column("id").to_pylist(), encoded(texts, model, end)):
                if writer and (count + len(ids) // 4 > FILE_IDS or len(writer.index) == FILE_DOCS):
                    finish()
                if not writer:
                    name = f"{base}/ids-{part:06d}-{len(done):06d}-{uuid.uuid4().hex}.zst"
                    writer, count = TokenFileWriter(system.open_output_stream(f"{name}.part")), 0
                writer.add(doc_id, ids)
                count += len(ids) // 4
        if writer:
            finish()
        listed = [dict(zip(listing.names, row)) for row in done]
        yield from pa.Table.from_pylist(listed, schema=listing).to_batches()

    system, base = file_system(folder)
    system.create_dir(base, recursive=True)
    listed = saved(ranged.mapInArrow(write, "path string, part int, file int, n_docs long, n_ids long"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = listed.groupBy("part").agg(F.sum("n_ids").alias("total")).withColumn(
        "earlier", F.coalesce(F.sum("total").over(before), F.lit(0))
    )
    return (
        listed.join(totals, "part")
        .withColumn("first_id", F.col("earlier") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .select("path", "part", "file", "n_docs", "n_ids", "first_id")
    )


def read_token_files(files: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document, read from the files: id, start, n_tokens, ids_crc32.

    Files go to tasks one by one; their size is bounded. start counts the ids of all
    documents before; ids_crc32 is the CRC-32 of the ids as stored.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = file_system(folder)
        for batch in batches:
            for path, first in zip(batch["path"], batch["first_id"]):
                with system.open_input_file(path) as source:
                    reader = TokenFileReader(source)
                    sums = []
                    for place in range(len(reader.index)):
                        crc = 0
                        for part in reader.parts(place):
                            crc = zlib.crc32(part, crc)
                        sums.append(crc)
                    ids = pd.Series(reader.index[:, 0].astype("int64"))
                    yield pd.DataFrame(
                        {
                            id_col: ids.astype("Int64").mask(ids == NO_ID),
                            "start": int(first) + reader.starts[:-1] // 4,
                            "n_tokens": reader.index[:, 1].astype("int64"),
                            "ids_crc32": np.array(sums, dtype="int64"),
                        }
                    )

    spread = files.select("path", "first_id").repartition(
        int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path"
    )
    return spread.mapInPandas(read, f"{id_col} long, start long, n_tokens long, ids_crc32 long")

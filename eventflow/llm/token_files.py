"""Token ids in seekable zstandard files: independent frames, a trailing seek table, checksums.

A file is a sequence of zstandard frames that decompress on their own, each of at most
``FRAME_BYTES`` of ids, then two skippable frames: the document index (zstandard-compressed: ids and
lengths of the documents) and the seek table (for each frame its compressed and decompressed size
and the low 32 bits of XXH64 of its content, then the footer of the public seekable format). A
reader takes the footer, the seek table and the index from the file's end and then decompresses only
the frames that hold the documents asked for; any zstandard tool can decompress the whole file.

Ids are little-endian, two bytes each where the vocabulary fits, else four. Documents are written in
ascending order of their key (null first, ties by text): the rows are range-partitioned and sorted
by Spark, each task writes one file of its range, and there are as many as the documents' bytes need. Tasks may run more than once: each attempt writes a
file of its own, and only the files that the finished job lists in the manifest are part of the
table.

Encoding cuts a text at each single white space between other characters, where the byte-level
pre-tokenizer cuts it anyway, and encodes each distinct piece once per worker with the tokenizers
library; the ids are those of encoding the whole text. How many pieces a worker remembers (``pieces``)
changes memory and time, not the ids.

Defined results: null text is empty and yields the end id only; a null key is written first; repeated
rows are written each; an empty table gives a manifest without documents; special-token strings in a
text are ordinary text; other columns are not written.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventflow.session import work_folder

from .common import give_back, takes_over

FRAME_BYTES = 1 << 18
#: Fixed values of the public seekable zstandard format.
SKIPPABLE, SEEK_TABLE, SEEK_FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: Bytes of stored documents for one file and task.
BYTES_PER_FILE = 256 << 20
#: Sizes from here on are the planner's word for not known.
UNKNOWN = 1 << 60
#: Distinct pieces a worker remembers: about 150 bytes each.
CACHE_PIECES = 1_000_000
#: Texts are cut into pieces together up to about so many characters.
CHARS_AT_ONCE = 200_000
#: White space as the tokenizer's own pattern has it (Unicode's White_Space).
SPACE = "\t-\r \x85\xa0  -     　"
PIECES = re.compile(f"[{SPACE}]?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])")
ODD = re.compile(f"[{SPACE}]")
#: Latin letters, perhaps after a line feed, then ASCII marks other than the apostrophe (which may open a contraction).
MARKED = re.compile("(\n?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
MANIFEST = "file string, width int, first_doc_id long, n_docs long, n_ids long, n_frames long, bytes long"


class Encoder:
    """Texts to little-endian ids; remembers the pieces it has met.

    A piece is what stands between two single spaces or line feeds, with the one before it. Latin letters
    are one word of the model and go to it directly; ASCII marks after them, up to the piece's end, are
    learned apart, as the pre-tokenizer parts them too. Texts with any other white space (or runs of it) are cut by ``PIECES`` instead.
    """

    def __init__(self, vocabulary: str, width: int, pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        bytes_of = ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.kind, self.width = f"<u{width}", width
        self.pieces = pieces
        self.known: dict[str, bytes] = {}
        # Byte-level tokens write a space as \u0120 and a line feed as \u010a.
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        #: Each id as it is written, a line feed's, and the characters that stand for a letter's bytes.
        self.raw = [i.to_bytes(width, "little") for i in range(len(self.opens))]
        self.feed = self._word("\u010a")
        self.mapped = {ord(c): bytes_of.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))}
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token[0] in "\u0120\u010a"

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Texts are taken together up to about ``CHARS_AT_ONCE`` characters, so that what they have new
        is learned at once; only such pieces are looked up twice."""
        held, n = [], 0
        for text in texts:
            held.append(text)
            n += len(text)
            if n >= CHARS_AT_ONCE:
                yield from self._together(held)
                held, n = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        # The first piece counts as if a line feed stood before it, whose id is cut off again.
        cut = [("\n" + text.replace("\n", " \n")).split(" ") for text in texts]
        found = [list(map(self.known.get, pieces)) for pieces in cut]
        new = [None if all(ids) else [i for i, x in enumerate(ids) if x is None] for ids in found]
        if any(new):
            self._learn({pieces[i]: None for pieces, at in zip(cut, new, strict=True) if at for i in at})
        known = self.known
        for text, pieces, ids, at in zip(texts, cut, found, new, strict=True):
            for i in at or ():
                ids[i] = known.get(pieces[i])
            yield b"".join(ids)[self.width :] if all(ids) else self._general(text)

    def _learn(self, pieces: dict[str, None]) -> None:
        if len(self.known) + len(pieces) > self.pieces:
            self.known = {}
        spaced, lined, parted = [], [], []
        known, raw, tokenize = self.known, self.raw, self.tokenizer.model.tokenize
        for p in pieces:
            if p.isascii() and p.isalpha():
                known[p] = b"".join([raw[t.id] for t in tokenize("\u0120" + p)])
            elif m := MARKED.fullmatch(p):
                stem = m[2] if m[2].isascii() else m[2].translate(self.mapped)
                ids = self.feed + self._word(stem) if m[1] else self._word("\u0120" + stem)
                if m[3]:
                    parted.append((p, ids, "\n" + m[3]))
                else:
                    known[p] = ids
            elif p and not ODD.search(p, 1) and p != "\n":
                if p[0] == "\n":
                    lined.append(p)
                elif not ODD.match(p):
                    spaced.append(p)
        lined += {marks for _, _, marks in parted if marks not in known}
        self._add(list(dict.fromkeys(lined)), "")
        self._add(spaced, " ")
        for p, ids, marks in parted:
            known[p] = ids + known[marks][self.width :]

    def _word(self, word: str) -> bytes:
        """Letters, with or without the space before them, are one word of the model."""
        return b"".join([self.raw[t.id] for t in self.tokenizer.model.tokenize(word)])

    def _add(self, pieces: list[str], before: str) -> None:
        """Ids of many pieces at once: each begins with the one token that opens with white space."""
        for at in range(0, len(pieces), 2048):
            part = pieces[at : at + 2048]
            ids = self._ids("".join(before + p for p in part))
            starts = np.flatnonzero(self.opens[ids])
            raw, cuts = ids.tobytes(), [*(starts * self.width).tolist(), len(ids) * self.width]
            for p, lo, hi in zip(part, cuts, cuts[1:], strict=False):
                self.known[p] = raw[lo:hi]

    def _general(self, text: str) -> bytes:
        return b"".join(self._ids(p).tobytes() for p in PIECES.findall(text))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(vocabulary: str, width: int, pieces: int = CACHE_PIECES) -> Encoder:
    """One for each worker process, until another operator's task runs there."""
    takes_over("token_files", _ENCODERS.clear)
    if (vocabulary, width) not in _ENCODERS:
        _ENCODERS[vocabulary, width] = Encoder(vocabulary, width)
    found = _ENCODERS[vocabulary, width]
    found.pieces = pieces
    return found


class Writer:
    """One file. ``add`` documents in order, then ``close``."""

    def __init__(self, sink, width: int, level: int = 3):
        self.sink, self.width = sink, width
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.pending = bytearray()
        self.frames: list[tuple[int, int, int]] = []
        self.keys: list[int | None] = []
        self.lengths: list[int] = []
        self.written = 0

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids) // self.width)
        self.pending += ids
        while len(self.pending) >= FRAME_BYTES:
            self._frame(bytes(self.pending[:FRAME_BYTES]))
            del self.pending[:FRAME_BYTES]

    def _frame(self, raw: bytes) -> None:
        packed = self.zstd.compress(raw)
        self.sink.write(packed)
        self.written += len(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.pending:
            self._frame(bytes(self.pending))
        lengths = np.array(self.lengths, "<i8")
        nulls = np.array([k is None for k in self.keys], "u1")
        keys = np.array([0 if k is None else k for k in self.keys], "<i8")
        index = struct.pack("<IQ", self.width, len(keys)) + keys.tobytes() + nulls.tobytes() + lengths.tobytes()
        packed = self.zstd.compress(index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEK_FOOTER)
        tail = struct.pack("<II", SKIPPABLE, len(packed) + 4) + packed + struct.pack("<I", zlib.crc32(packed))
        tail += struct.pack("<II", SEEK_TABLE, len(table)) + table
        self.sink.write(tail)
        self.written += len(tail)


class Reader:
    """Reads the tail of a file, then any of its documents."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_FOOTER or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table at the file's end")
        at = size - 9 - 12 * n
        source.seek(at)
        table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sums = table[:, 2]
        self.packed_at = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.raw_at = np.concatenate([[0], np.cumsum(table[:, 1])])
        start = int(self.packed_at[-1])
        source.seek(start)
        magic, length = struct.unpack("<II", source.read(8))
        body = source.read(length)
        if magic != SKIPPABLE or zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("the document index is damaged")
        index = zstandard.ZstdDecompressor().decompress(body[:-4])
        self.width, docs = struct.unpack_from("<IQ", index)
        self.keys = np.frombuffer(index, "<i8", docs, 12)
        self.nulls = np.frombuffer(index, "u1", docs, 12 + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(index, "<i8", docs, 12 + 9 * docs)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self._kept: tuple[int, bytes] = (-1, b"")

    def frame(self, i: int) -> bytes:
        if self._kept[0] != i:
            self.source.seek(int(self.packed_at[i]))
            raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.packed_at[i + 1] - self.packed_at[i])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
                raise ValueError(f"frame {i} is damaged")
            self._kept = (i, raw)
        return self._kept[1]

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document; decompresses only the frames they lie in."""
        lo, hi = int(self.starts[i]) * self.width, int(self.starts[i + 1]) * self.width
        parts, f = [], int(np.searchsorted(self.raw_at, lo, "right")) - 1
        while lo < hi:
            end = min(hi, int(self.raw_at[f + 1]))
            base = int(self.raw_at[f])
            parts.append(self.frame(f)[lo - base : end - base])
            lo, f = end, f + 1
        return np.frombuffer(b"".join(parts), f"<u{self.width}")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any folder all executors reach: a path, or a URI of a store pyarrow knows."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def files_for(docs: DataFrame) -> int:
    """How many files the documents need, by the bytes of the tables they come from as the planner knows
    them, so that nothing is read for it. Rows that are in no table have no such size and add none."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return -(-sum(s for s in sizes if s < UNKNOWN) // BYTES_PER_FILE)


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, width: int = 2, key: str = "doc_id", text: str = "text", partitions: int | None = None, pieces: int = CACHE_PIECES) -> DataFrame:
    """Writes the documents' ids to files in the folder and returns the manifest (read again)."""
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), files_for(docs))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, F.asc("doc_id"), F.crc32("text")).sortWithinPartitions("doc_id", "text")
    last = np.array([end_id], f"<u{width}").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, width, pieces).encode
        writer = None
        for batch in batches:
            if writer is None:
                system, base = file_system(folder)
                system.create_dir(base, recursive=True)
                name = f"{uuid.uuid4().hex}.zst"
                writer = Writer(system.open_output_stream(f"{base}/{name}", compression=None), width)
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 64):
                for k, ids in zip(keys[at : at + 64].to_pylist(), encode(texts[at : at + 64].to_pylist()), strict=True):
                    writer.add(k, ids + last)
        if writer is not None:
            writer.close()
            writer.sink.close()
            row = {"file": [name], "width": [width], "first_doc_id": [writer.keys[0]], "n_docs": [len(writer.keys)], "n_ids": [sum(writer.lengths)], "n_frames": [len(writer.frames)], "bytes": [writer.written]}
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))
        give_back()

    path = f"{folder}/manifest"
    rows.mapInArrow(task, MANIFEST).write.parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


def read(manifest: DataFrame, folder: str, with_ids: bool = False, only: list[int] | None = None) -> DataFrame:
    """One row for each document, read from the files: where it starts among all ids, its length,
    the crc32 of its ids as unsigned 32-bit integers and, if asked for, the ids. ``only`` (a short
    list of keys) decompresses no other documents' frames."""
    before = W.orderBy(F.asc_nulls_first("first_doc_id"), "file").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    files = files.repartition(max(1, manifest.count()))
    wanted = None if only is None else np.array(sorted(only), np.int64)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{base}/{name}"
                with system.open_input_file(path) as source:
                    reader = Reader(source, system.get_file_info(path).size)
                    picked = range(len(reader.keys)) if wanted is None else np.flatnonzero(np.isin(reader.keys, wanted) & ~reader.nulls)
                    rows: list[tuple] = []
                    held = 0
                    for i in picked:
                        ids = reader.ids(i)
                        rows.append((None if reader.nulls[i] else int(reader.keys[i]), first + int(reader.starts[i]), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *[ids.astype(np.int64)] * with_ids))
                        held += len(ids) * with_ids + 1
                        if held > 1_000_000 or len(rows) == 10_000:
                            yield _batch(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, schema)

    return files.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def encode_table(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None, pieces: int = CACHE_PIECES) -> DataFrame:
    """Write, then read back, all documents."""
    folder = folder or work_folder(docs.sparkSession, "token-files")
    return read(write(docs, folder, vocabulary, end_id, pieces=pieces), folder)


def open_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of files written earlier."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")

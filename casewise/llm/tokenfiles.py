"""Operator 11, token files: ids of documents in independent zstandard frames with a trailing seek table.

A file follows the public seekable format of zstandard, so that any zstandard tool decompresses it to the plain run of
little-endian unsigned 32-bit ids:

* data frames, each compressed by itself, of at most FRAME_IDS ids. A document that fits in one frame is in one frame;
  a longer one has frames of its own. Each frame carries a content checksum;
* one skippable frame, the index: an Arrow stream of doc_id and n_tokens in file order, compressed;
* one skippable frame, the seek table: compressed size, decompressed size (0 for the index) and the low 32 bits of
  XXH64 for every frame before it, then their number, a descriptor and a magic number.

A reader takes the last bytes, then the seek table, then the index, and decompresses the frames of the documents that
are asked for, no others. Each frame is checked against the seek table.

Spark deals documents by ranges of doc_id; a task writes its range in files of at most FILE_IDS ids and FILE_DOCS
documents (a longer document is alone in a file) under a temporary name that a rename makes final, so that a repeated
attempt leaves the same files. Writing and reading hold one frame and one index at a time.

Documents are written in ascending doc_id, nulls first; repeated doc_ids follow one another by their text's hash. A
null or empty text has the end id alone. Very long texts are written whole. Other columns are left behind, whatever
their names. An empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.llm.common import cut, partitions
from casewise.llm.packing import _Mapped

END = 2
#: Ids of a frame; ids and documents of a file.
FRAME_IDS, FILE_IDS, FILE_DOCS = 1 << 16, 1 << 26, 1 << 20
#: Neighbouring frames that one task reads.
RUN = 64
LEVEL = 3
#: Fixed values of the format: magic numbers of a skippable frame, of the seek table's frame and at the very end.
SKIPPABLE, SEEK_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Fixed value: the descriptor's bit that says that entries have checksums.
WITH_CHECKSUMS = 0x80
#: Units that a worker remembers, and the longest of them in characters; texts that it encodes at a time.
UNITS_KEPT, UNIT_CHARS, TEXTS = 450_000, 48, 200
#: Fixed value: up to this character letters are the same in all versions of Unicode of the last ten years.
LETTERS = "\u052f"
#: The characters that the tokenizer's own pattern calls white space, those beyond ASCII by themselves, and
#: what of the others stands for more than one space or line end between two words.
WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = rf"\t-\r {WIDE}"
ODD = ("  ", "\n\n", " \n", "\n ", "\t", "\x0b", "\x0c", "\r")
UNIT = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


class _Words(dict):
    """Ids of words with a space before them, by the word; what is not known yet is learnt when it is asked for."""

    def __init__(self, tokenizer):
        self.tokenize, self.whole = tokenizer.model.tokenize, tokenizer.encode_batch_fast
        self.mapped = _Mapped()
        self.space = " ".translate(self.mapped)
        self.before: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.ends = {end: self.ids(self.tokenize(end)) for end in ".,"}
        self.line = self.ids(self.tokenize("\n".translate(self.mapped)))

    @staticmethod
    def ids(tokens) -> bytes:
        return array("I", [t.id for t in tokens]).tobytes()

    def renew(self) -> None:
        """Bounds the memory: of what is known only what is met again goes on."""
        if len(self) > UNITS_KEPT:
            self.before = dict(self)
            self.clear()
        if len(self.parts) > UNITS_KEPT:
            self.parts.clear()

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            if "\n" in word:
                # a single line end stands by itself, and no space is before the next word
                first, *more = word.split("\n")
                return self[first] + b"".join([self.line + self.learn(w) for w in more])
            found = self.learn(" " + word)
        if len(word) <= UNIT_CHARS:
            self[word] = found
        return found

    def learn(self, unit: str) -> bytes:
        end = self.ends.get(unit[-1])
        letters = unit if end is None else unit[:-1]
        spaced = letters[:1] == " "
        word = letters[1:] if spaced else letters
        if len(unit) > UNIT_CHARS or not word.isalpha() or not word.isascii() and max(word) > LETTERS:
            return array("I", self.whole([unit], add_special_tokens=False)[0].ids).tobytes()
        # a pre-token in the model's own characters
        token = (self.space if spaced else "") + (word if word.isascii() else word.translate(self.mapped))
        found = self.parts.get(token)
        if found is None:
            found = self.parts[token] = self.ids(self.tokenize(token))
        return found if end is None else found + end


class UnitEncoder:
    """Ids of texts by units that a byte-level tokenizer never joins: a word with the space before it, or other space.

    Only for tokenizers whose first step is the byte-level pattern without a normalizer; others, and texts that spell
    an added token, are encoded whole. Words of letters go to the model itself, with a dot or comma after them or
    without; other units to the tokenizer. What was met of late is remembered, so that memory is bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_unit = self.tokenizer.normalizer is None and repr(self.tokenizer.pre_tokenizer) == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
        self.words = _Words(self.tokenizer) if self.by_unit else None

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_unit:
            return self.whole(texts)
        words = self.words
        words.renew()
        get, out = words.__getitem__, []
        for t in texts:
            if any(s in t for s in self.special):
                out += self.whole([t])
            elif any(s in t for s in ODD) or not t.isascii() and any(s in t for s in WIDE) or t[:1] in (" ", "\n", "") or t[-1] in " \n":
                out.append(b"".join(map(words.learn, UNIT.findall(t))))
            else:
                # single spaces and line ends between words: a text is cut at its spaces
                first, *rest = t.split(" ")
                head, *more = first.split("\n")
                out.append(words.learn(head) + b"".join([words.line + words.learn(w) for w in more]) + b"".join(map(get, rest)))
        return out


_ENCODERS: dict[str, UnitEncoder] = {}


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI, or of a path on a disk that all machines share."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def skippable(magic: int, payload: bytes) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


class TokenWriter:
    """One file; documents are appended in order. Holds one frame, the seek table and the index."""

    def __init__(self, files: fs.FileSystem, path: str, kind: pa.DataType, frame_ids: int = FRAME_IDS):
        self.files, self.path, self.kind, self.width = files, path, kind, 4 * frame_ids
        self.draft = f"{path}.{uuid.uuid4().hex}.tmp"
        self.out = files.open_output_stream(self.draft)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.table: list[bytes] = []
        self.frame = bytearray()
        self.docs: list = []
        self.lengths: list[int] = []
        self.ids = 0

    def close_frame(self) -> None:
        if self.frame:
            data = bytes(self.frame)
            packed = self.zstd.compress(data)
            self.out.write(packed)
            self.table.append(struct.pack("<III", len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.frame = bytearray()

    def add(self, doc_id, ids: bytes) -> None:
        if len(self.frame) + len(ids) > self.width:
            self.close_frame()
        for at in range(0, len(ids), self.width):
            self.frame += ids[at : at + self.width]
            if len(self.frame) == self.width:
                self.close_frame()
        if len(ids) > self.width:
            self.close_frame()
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.ids += len(ids) // 4

    def close(self) -> None:
        self.close_frame()
        sink = pa.BufferOutputStream()
        index = pa.table({"doc_id": pa.array(self.docs, self.kind), "n_tokens": pa.array(self.lengths, pa.int64())})
        with pa.ipc.new_stream(sink, index.schema) as w:
            w.write_table(index)
        data = sink.getvalue().to_pybytes()
        packed = skippable(SKIPPABLE, self.zstd.compress(data))
        self.table.append(struct.pack("<III", len(packed), 0, xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.out.write(packed)
        self.out.write(skippable(SEEK_TABLE, b"".join(self.table) + struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEKABLE)))
        self.out.close()
        if self.files.get_file_info(self.path).type != fs.FileType.NotFound:
            self.files.delete_file(self.path)
        self.files.move(self.draft, self.path)


class TokenFile:
    """Reads a file by its seek table; `decompressed` counts the frames that were."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.file = files.open_input_file(path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEKABLE or flags != WITH_CHECKSUMS:
            raise ValueError(f"{path} does not end with a seek table with checksums")
        begin = size - 9 - 12 * count - 8
        head = self.at(begin, 8 + 12 * count)
        if struct.unpack("<II", head[:8]) != (SEEK_TABLE, 12 * count + 9):
            raise ValueError(f"{path} has a broken seek table")
        self.path, self.decompressed = path, 0
        self.frames: list[tuple[int, int, int, int]] = []  # place, packed size, first id, checksum
        place_, first = 0, 0
        for packed, plain, check in struct.iter_unpack("<III", head[8:]):
            self.frames.append((place_, packed, first, check))
            place_, first = place_ + packed, first + plain // 4
        self.index_frame = self.frames.pop()
        self.n_tokens = first
        if place_ != begin:
            raise ValueError(f"{path} has frames that its seek table does not list")
        self.zstd = zstandard.ZstdDecompressor()

    def at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def checked(self, data: bytes, check: int) -> bytes:
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"{self.path} has a frame that differs from its checksum")
        return data

    def documents(self) -> pa.Table:
        """doc_id and n_tokens in file order."""
        start, size, _, check = self.index_frame
        return pa.ipc.open_stream(self.checked(self.zstd.decompress(self.at(start + 8, size - 8)), check)).read_all()

    def frame(self, k: int) -> bytes:
        start, size, _, check = self.frames[k]
        self.decompressed += 1
        return self.checked(self.zstd.decompress(self.at(start, size)), check)

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end: int = END, frame_ids: int = FRAME_IDS, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes documents with `end` after each and returns a row for each file: part, number, path, n_docs, n_tokens.

    The rows are checkpointed, so that files are written once; (part, number) is the files' order. folder: a URI or a
    path that driver and executors share; the tasks write with pyarrow's file systems.
    """
    # the scan's partition parts rows that are equal in all else, so that no group of them is a task of its own
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.spark_partition_id().alias("_part"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("_part")]
    dealt = keyed.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    last = array("I", [end]).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's own thread is the one Spark counts
        coder = _ENCODERS.get(tokenizer) or _ENCODERS.setdefault(tokenizer, UnitEncoder(tokenizer))
        files, base = place(folder)
        files.create_dir(base, recursive=True)
        part, done, out = TaskContext.get().partitionId(), [], None
        for small in (b.slice(k, TEXTS) for b in batches for k in range(0, b.num_rows, TEXTS)):
            coded = coder.encode([t or "" for t in small.column(1).to_pylist()])
            for key, ids in zip(small.column(0).to_pylist(), coded, strict=True):
                ids += last
                if out and (out.ids + len(ids) // 4 > file_ids or len(out.docs) >= file_docs):
                    out.close()
                    done.append(out)
                    out = None
                if out is None:
                    out = TokenWriter(files, f"{base}/part-{part:05d}-{len(done):05d}.zst", small.schema.field(0).type, frame_ids)
                out.add(key, ids)
        if out:
            out.close()
            done.append(out)
        if done:
            n = len(done)
            names = [f"{folder}/{w.path.rsplit('/', 1)[1]}" for w in done]
            columns = [pa.array([part] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(names), pa.array([len(w.docs) for w in done], pa.int64()), pa.array([w.ids for w in done], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "number", "path", "n_docs", "n_tokens"])

    return cut(dealt.mapInArrow(write, "part int, number int, path string, n_docs long, n_tokens long"))


def token_index(files: DataFrame, kind: str = "bigint") -> DataFrame:
    """A row for each document: doc_id, path, at (its first id's place in the file), start (over all files), n_tokens.

    kind: the type of doc_id. The ids before a file come from a sum over one row for each file.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.select("path", before.cast("long").alias("base"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                file = TokenFile(*place(path))
                docs = file.documents()
                file.close()
                at, here = [], 0
                for n in docs.column("n_tokens").to_pylist():
                    at.append(here)
                    here += n
                starts = pa.array([base + x for x in at], pa.int64())
                for b in pa.table({"doc_id": docs.column("doc_id"), "path": pa.array([path] * len(at)), "at": pa.array(at, pa.int64()), "start": starts, "n_tokens": docs.column("n_tokens")}).to_batches(20_000):
                    yield b

    return placed.repartition(partitions(files), "path").mapInArrow(rows, f"doc_id {kind}, path string, at long, start long, n_tokens long")


def _read(index: DataFrame, value: str, take, frame_ids: int) -> DataFrame:
    """The rows of an index with what take(chunks) makes of a document's ids; neighbouring documents share a task."""
    kinds = {c: index.schema[c].dataType.simpleString() for c in ("doc_id", "path", "at", "start", "n_tokens")}
    run = (F.col("at") / (RUN * frame_ids)).cast("long")
    dealt = index.select(*kinds).repartition(partitions(index), "path", run).sortWithinPartitions("path", "at")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held, data = None, -1, b""
        for batch in batches:
            for small in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                found = []
                for path, at, n in zip(*(small.column(k).to_pylist() for k in (1, 2, 4)), strict=True):
                    if file is None or file.path != place(path)[1]:
                        if file:
                            file.close()
                        file, held, near = TokenFile(*place(path)), -1, 0

                    def chunks(at: int, left: int) -> Iterator[bytes]:
                        nonlocal held, data, near
                        # documents come in file order, so that the search goes on from the frame before
                        while near + 1 < len(file.frames) and file.frames[near + 1][2] <= at:
                            near += 1
                        while left:
                            if held != near:
                                data, held = file.frame(near), near
                            begin = 4 * (at - file.frames[near][2])
                            piece = data[begin : begin + 4 * left]
                            yield piece
                            at, left = at + len(piece) // 4, left - len(piece) // 4
                            near += bool(left)

                    found.append(take(chunks(at, n)))
                columns = [small.column(0), small.column(1), small.column(2), small.column(3), small.column(4), pa.array(found, pa.binary() if value == "binary" else pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*kinds, "value"])
        if file:
            file.close()

    return dealt.mapInArrow(rows, ", ".join(f"{c} {k}" for c, k in kinds.items()) + f", value {value}")


def read_tokens(index: DataFrame, frame_ids: int = FRAME_IDS) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary) of the documents whose rows of token_index() are given."""
    return _read(index, "binary", b"".join, frame_ids).select("doc_id", "start", "n_tokens", F.col("value").alias("ids"))


def _crc(chunks: Iterator[bytes]) -> int:
    found = 0
    for c in chunks:
        found = zlib.crc32(c, found)
    return found


def read_digests(index: DataFrame, frame_ids: int = FRAME_IDS) -> DataFrame:
    """doc_id, start, n_tokens and the ids' crc32; holds one frame at a time, however long a document is."""
    return _read(index, "bigint", _crc, frame_ids).select("doc_id", "start", "n_tokens", F.col("value").alias("ids_crc32"))

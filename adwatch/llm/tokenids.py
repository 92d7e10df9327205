"""Token ids in binary files: independent zstandard frames, a seek table at the end, a checksum for every frame.

A file is a run of frames, each holding the ids of whole documents as little-endian unsigned 32-bit numbers, followed by
a skippable frame with one entry per frame (compressed size, content size, low 32 bits of the content's XXH64) and a
footer, the seekable layout of the zstandard project. A second skippable frame before it lists the documents: id and
number of ids, by frame. A reader takes the seek table from the file's end, then only the frames it needs.

Rows are dealt by range of ``doc_id`` (ties by the text's hash), sorted in place and written by the tasks; each file gets
its final name by one rename, so a task that is run again replaces its own file. What the driver holds is nothing but the
folder's name; the manifest has one row per file.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adwatch.llm.bpe import tokenizer
from adwatch.llm.common import kept, settle, tidy

#: Fixed values of the seekable layout.
SKIPPABLE_SEEK = 0x184D2A5E
SKIPPABLE_DOCUMENTS = 0x184D2A50
SEEKABLE_FOOTER = 0x8F92EAB1

#: Bytes of ids in a frame before it is closed at the next document's end.
FRAME_BYTES = 1 << 20
#: Entries of a worker's table of encoded words; beyond it the table starts afresh.
CACHED_WORDS = 600_000


class Encoder:
    """Ids of the ``tokenizers`` library, with every word encoded once while it stays in a bounded table.

    A byte-level vocabulary with its usual pattern never merges across a single space between two visible characters:
    the space begins the next word. Texts are cut there; texts with other spacing beside a space go to the library whole.
    """

    def __init__(self, path: str, ranks: str | None):
        self.own, self.fast = tokenizer(path), None
        self.forget()
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def word(self, word: str) -> list[int]:
        # ranks and file are one vocabulary; where pattern classes of the two libraries could differ, the library decides
        if self.fast is not None and (word.isascii() or max(word) < "ɐ") and "<|" not in word:
            return self.fast.encode_ordinary(word)
        return self.own.encode(word, add_special_tokens=False).ids

    def places(self, words: list[str], lead: str) -> np.ndarray:
        """Places of words in the table; ``lead`` stands before each, and new ones are encoded once."""
        known, size, new = self.words[lead], len(self.starts) - 1, []
        get = known.get
        found = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
        for i in np.flatnonzero(found < 0).tolist():
            w = words[i]
            if w not in known:  # a first word may stand in several texts
                known[w] = size + len(new)
                new.append(self.word(lead + w) if lead + w else [])
            found[i] = known[w]
        if new:
            lengths = np.fromiter(map(len, new), np.int64, len(new))
            self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(lengths)]
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(new), "<u4", int(lengths.sum()))])
        return found

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of all texts of a batch: its distinct words are looked up once, their ids gathered by position."""
        out = [b""] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if text and self.odd(text):
                out[i] = np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            elif text:
                plain.append(i)
        if not plain:
            return out
        if sum(map(len, self.words.values())) >= CACHED_WORDS:
            self.forget()
        lists = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        ends = np.asarray(lists.offsets)
        coded = lists.flatten().dictionary_encode()
        codes = np.asarray(coded.indices)
        inner = np.ones(len(codes), bool)
        inner[ends[:-1]] = False  # the first word has no space before it
        listed = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        used = np.zeros(len(listed), bool)
        used[codes[inner]] = True
        table = np.full(len(listed), -1, np.int64)
        table[used] = self.places([listed[i] for i in np.flatnonzero(used).tolist()], " ")
        place = table[codes]
        place[ends[:-1]] = self.places([listed[i] for i in codes[ends[:-1]].tolist()], "")
        lengths = (self.starts[1:] - self.starts[:-1])[place]
        after = np.cumsum(lengths)
        at = np.repeat(self.starts[place] - (after - lengths), lengths) + np.arange(int(after[-1]))
        data, stops = self.ids[at].tobytes(), 4 * np.r_[0, after][ends]
        for i, a, b in zip(plain, stops[:-1].tolist(), stops[1:].tolist()):
            out[i] = data[a:b]
        return out

    def forget(self) -> None:
        self.words, self.starts, self.ids = {"": {}, " ": {}}, np.zeros(1, np.int64), np.empty(0, "<u4")

    @staticmethod
    def odd(text: str) -> bool:
        """Whether a space stands at an end or beside other white space."""
        return text[0] == " " or text[-1] == " " or "  " in text or any(c in text and (" " + c in text or c + " " in text) for c in _SPACES)


_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]


@kept
def encoder(path: str, ranks: str | None) -> Encoder:
    return Encoder(path, ranks)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as the cluster's default file system has it; tasks must not take it for a local one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def open_store(uri: str):
    """The file system and path of a folder, by its address."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


class Writer:
    """One file: documents go in one by one, ``close`` puts it in its place."""

    def __init__(self, store, path: str, attempt: str, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.store, self.path, self.draft = store, path, f"{path}.{attempt}"
        self.out = store.open_output_stream(self.draft)
        self.pack = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.listed: list[tuple[int, int | None, int]] = []
        self.held, self.size, self.frame_bytes = [], 0, frame_bytes

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.held.append(ids)
        self.listed.append((len(self.frames), doc_id, len(ids) // 4))
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if self.held:
            data = b"".join(self.held)
            packed = self.pack.compress(data)
            self.out.write(packed)
            self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = struct.pack("<I", len(self.listed)) + b"".join(
            struct.pack("<I?qQ", frame, doc is not None, doc or 0, n) for frame, doc, n in self.listed)
        packed = zlib.compress(body, 1)
        listed = struct.pack("<II", SKIPPABLE_DOCUMENTS, len(packed)) + packed
        self.out.write(listed)
        entries = b"".join(struct.pack("<III", *f) for f in [*self.frames, (len(listed), 0, 0)])
        footer = struct.pack("<IBI", len(self.frames) + 1, 0x80, SEEKABLE_FOOTER)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + len(footer)) + entries + footer)
        self.out.close()
        self.store.move(self.draft, self.path)


class Reader:
    """Random access to a file: only the frames of the documents asked for are decompressed, each against its checksum."""

    def __init__(self, store, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_FOOTER:
            raise ValueError(f"{path} has no seek table")
        table = self._at(size - 9 - 12 * count, 12 * count)
        entries = [struct.unpack_from("<III", table, 12 * i) for i in range(count)]
        starts = np.r_[0, np.cumsum([e[0] for e in entries])]
        self.frames = [(int(starts[i]), *entries[i]) for i in range(count - 1)]
        packed = self._at(int(starts[count - 1]), entries[-1][0])[8:]
        body = zlib.decompress(packed)
        (n,) = struct.unpack_from("<I", body)
        self.listed = [(f, d if known else None, k) for f, known, d, k in (struct.unpack_from("<I?qQ", body, 4 + 21 * i) for i in range(n))]

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, i: int) -> bytes:
        import xxhash
        import zstandard

        offset, packed, size, check = self.frames[i]
        data = zstandard.ZstdDecompressor().decompress(self._at(offset, packed), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} does not fit its checksum")
        return data

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int, int | None, bytes]]:
        """Place in the file, id and ids of the documents, or of those wanted, in the file's order."""
        current, data, at = -1, b"", 0
        for place, (f, doc, n) in enumerate(self.listed):
            if f != current:
                current, data, at = f, None, 0
            if wanted is None or doc in wanted:
                data = self.frame(f) if data is None else data
                yield place, doc, data[at:at + 4 * n]
            at += 4 * n


def write_token_files(df: DataFrame, folder: str, path: str, ranks: str | None = None, end_id: int | None = 0,
                      doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode every text and write the ids in ascending order of ``doc_id`` to files in ``folder``.

    ``path`` is a byte-level vocabulary of the ``tokenizers`` library, ``ranks`` the same vocabulary as a rank file, if
    there is one. ``end_id`` is put after each document. Returns the manifest: file, documents, ids, start (ids in all
    files before), first_id. Null texts have the end id alone; null ids come first; rows with equal ids stand in order of
    their texts' hashes, and rows that are equal throughout are interchangeable. An empty table gives an empty manifest.
    """
    spark = df.sparkSession
    folder = qualified(spark, folder)
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"),
                     F.xxhash64(F.col(f"`{text}`")).alias("tie"))
    order = ("doc_id", "tie")
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    ending = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        context, own, out = TaskContext.get(), encoder(path, ranks), None
        name, count, total, first = f"ids-{context.partitionId():06d}.zst", 0, 0, None
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), own.batch(batch.column(1).to_pylist())):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out, first = Writer(store, f"{root}/{name}", f"{context.taskAttemptId()}.part"), doc
                ids = ids + ending
                out.add(doc, ids)
                count, total = count + 1, total + len(ids) // 4
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([context.partitionId()], pa.int32()), pa.array([name]), pa.array([count], pa.int64()),
                                   pa.array([total], pa.int64()), pa.array([first], pa.int64())],
                                  names=["part", "file", "documents", "ids", "first_id"])

    written = settle(dealt.sortWithinPartitions(*order).mapInArrow(tidy(run), "part int, file string, documents long, ids long, first_id long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return written.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """The documents of the files, or those wanted, from the files alone: doc_id, start, n_tokens, token_ids (binary).

    Every frame read is held against its checksum; a file that fails raises.
    """
    asked = None if wanted is None else set(wanted)
    folder = qualified(manifest.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader, rows = Reader(store, f"{root}/{name}"), []
                offsets = np.r_[0, np.cumsum([n for _, _, n in reader.listed], dtype=np.int64)] + start
                for place, doc, ids in reader.documents(asked):
                    rows.append((doc, int(offsets[place]), len(ids) // 4, ids))
                    if len(rows) == 500:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    spread = manifest.select("file", "start").repartition(max(1, manifest.count()))
    return spread.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, token_ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                           names=["doc_id", "start", "n_tokens", "token_ids"])

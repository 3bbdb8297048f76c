"""Token-id files with a shared zstandard dictionary.

Documents are encoded, each document's serialised id array is compressed by itself with a
dictionary trained on a sample of such arrays, and files are written in ascending order of
doc_id. A file holds the frames, then an index (doc_id, first id, ids, frame place and length),
then a footer with the dictionary's hash; so one short document is read with three small reads. The
dictionary and a manifest of files, with the ids before each, lie beside them.

File: frames | index rows ``<qQIQI`` | footer ``<QQB32s4s`` (index place, documents, bytes of an id,
SHA-256 of the dictionary, b"DFZ1").
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docflow.llm.arrow import map_rows, utf8
from docflow.plans.staging import new_path, staged

_ROW, _FOOTER, _MAGIC = struct.Struct("<qQIQI"), struct.Struct("<QQB32s4s"), b"DFZ1"
#: doc_id of an index row whose document has none.
NO_ID = -(1 << 63)


def open_store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a URI that all machines share (file, hdfs, s3, ...)."""
    if path.startswith("file:/"):
        path = "file:///" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


#: Punctuation that ends words; cut off, it leaves the stem that the vocabulary of a corpus repeats.
_TAIL = b".,;:!?|%&*#$)"
#: Words of these letters alone are one pre-token, and no normalisation changes them.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte, by their rule."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Whole texts by a tokenizers file whose pre-tokens never cross white space.

    The ids of a text are those of its words in turn, so words are encoded by the library once
    and kept (``keep`` new ones and as many older) for the next texts. For byte-level BPE files that lower-case and
    take runs of letters as pre-tokens, a word of plain letters goes to the library's BPE model
    at once, and closing punctuation is parted from it, where a pre-token ends anyway; all other
    words go through the whole of the library.
    """

    def __init__(self, source: str, keep: int = 400_000):
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.keep, self.known, self.older = keep, {}, {}
        parts = json.loads(source)
        steps = lambda x, name: [x] if x and "type" in x and x["type"] != "Sequence" else (x or {}).get(name, [])
        normal = {n["type"] for n in steps(parts.get("normalizer"), "normalizers")}
        split = steps(parts.get("pre_tokenizer"), "pretokenizers")
        letters = any(r"|[\p{L}]+|" in p.get("pattern", {}).get("Regex", "") for p in split)
        level = any(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in split)
        self.lower = "Lowercase" in normal
        self.quick = parts["model"]["type"] == "BPE" and normal == {"NFC", "Replace", "Lowercase"} and letters and level
        self.letters = byte_letters()
        self.one = [k.to_bytes(self.kind.itemsize, "little") for k in range(self.tokenizer.get_vocab_size())]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _stored(self, ids: list[int]) -> bytes:
        return b"".join([self.one[k] for k in ids])

    def _word(self, word: bytes) -> bytes:
        if len(self.known) >= self.keep:  # words met again come back from the older ones
            self.known, self.older = {}, self.known
        if (found := self.older.get(word)) is not None:
            self.known[word] = found
            return found
        stem = word.rstrip(_TAIL) if self.quick else word
        text = stem.decode()
        if not self.quick or not (text.isascii() and text.isalpha() or _PLAIN.fullmatch(text)):
            found = self.known[word] = self._stored(self._ids(word.decode()))
            return found
        found = self.known.get(stem)
        if found is None and (found := self.older.get(stem)) is not None:
            self.known[stem] = found
        seen = found is not None
        if not seen:
            shown = text if text.isascii() else stem.decode("latin-1").translate(self.letters)
            found = self.known[stem] = self._stored([t.id for t in self.tokenizer.model.tokenize(shown)])
        if tail := word[len(stem) :]:
            ending = self.known.get(tail)
            if ending is None:
                ending = self.known[tail] = self._stored(self._ids(tail.decode()))
            found += ending
            if seen:  # worth keeping whole
                self.known[word] = found
        return found

    def encode(self, text: bytes | None) -> bytes:
        """Serialised ids of a whole text in UTF-8, without an end id."""
        text = text or b""
        words = (text.lower() if self.lower else text).split()
        get, make = self.known.get, self._word
        return b"".join([get(w) or make(w) for w in words])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(source: str) -> WordEncoder:
    """The encoder of a tokenizer, made once in each Python worker."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(source)
    return _ENCODERS[key]


@dataclass(frozen=True)
class StoreParams:
    """sample_rows documents, sample_ids ids of each from its middle, train the dictionary."""

    end_id: int | None = 1
    level: int = 3
    dictionary_bytes: int = 64 << 10
    sample_rows: int = 2000
    sample_ids: int = 2048
    file_bytes: int = 32 << 20


def train_dictionary(documents: DataFrame, source: str, params: StoreParams) -> bytes:
    """A dictionary from a bounded sample: rows of least hash of doc_id.

    A sample that is too small or too much alike to train on is itself the dictionary's content, and
    the least ids are that of an empty one; so every store has a dictionary and one format.
    """
    chosen = documents.select("doc_id").filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.sample_rows)
    rows = documents.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi")
    shared = documents.sparkSession.sparkContext.broadcast(source)

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        own = encoder(shared.value)
        size = params.sample_ids * own.kind.itemsize
        arrays = [own.encode(t) for t in utf8(batch.column(0))]
        cuts = [max(0, len(a) - size) // 2 // own.kind.itemsize * own.kind.itemsize for a in arrays]
        return {"ids": [a[c : c + size] for a, c in zip(arrays, cuts, strict=True)]}

    sample = map_rows(rows, ["text"], "ids binary", work, pa.schema([("ids", pa.binary())]))
    arrays = sorted(r.ids for r in sample.limit(params.sample_rows).collect() if r.ids)
    try:
        return zstandard.train_dictionary(params.dictionary_bytes, [bytes(a) for a in arrays]).as_bytes()
    except zstandard.ZstdError:
        least = np.arange(256, dtype=encoder(source).kind).tobytes()
        return (least + b"".join(bytes(a) for a in arrays))[-params.dictionary_bytes :]


class _Writer:
    """One file at a time; a file's index stays in memory until it is closed."""

    def __init__(self, uri: str, name: str, width: int, digest: bytes):
        self.fs, self.folder = open_store(uri)
        self.name, self.width, self.digest = name, width, digest
        self.stream = self.fs.open_output_stream(f"{self.folder}/{name}")
        self.index, self.place, self.ids = [], 0, 0

    def add(self, doc_id: int | None, count: int, frame: bytes) -> None:
        self.stream.write(frame)
        self.index.append(_ROW.pack(NO_ID if doc_id is None else doc_id, self.ids, count, self.place, len(frame)))
        self.place += len(frame)
        self.ids += count

    def close(self) -> None:
        self.stream.write(b"".join(self.index))
        self.stream.write(_FOOTER.pack(self.place, len(self.index), self.width, self.digest, _MAGIC))
        self.stream.close()


class TokenFile:
    """Reader of one file; only the footer and index are read at once."""

    def __init__(self, uri: str, name: str, dictionary: bytes):
        fs, folder = open_store(uri)
        self.file = fs.open_input_file(f"{folder}/{name}")
        size = self.file.size()
        footer = self.file.read_at(_FOOTER.size, size - _FOOTER.size)
        place, count, width, digest, magic = _FOOTER.unpack(footer)
        if magic != _MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("no token file, or one written with another dictionary")
        self.kind = np.dtype(f"<u{width}")
        self.index = list(_ROW.iter_unpack(self.file.read_at(count * _ROW.size, place)))
        self.decompressor = decompressor(dictionary)

    def ids(self, row: int) -> np.ndarray:
        """Token ids of the row-th document of the file, by one read."""
        _, _, count, place, size = self.index[row]
        data = self.decompressor.decompress(self.file.read_at(size, place), max_output_size=count * self.kind.itemsize)
        return np.frombuffer(data, dtype=self.kind)

    def find(self, doc_id: int) -> np.ndarray | None:
        """Token ids of a document by binary search, or None."""
        low, high = 0, len(self.index)
        while low < high:
            middle = (low + high) // 2
            if self.index[middle][0] < doc_id:
                low = middle + 1
            else:
                high = middle
        return self.ids(low) if low < len(self.index) and self.index[low][0] == doc_id else None

    def close(self) -> None:
        self.file.close()


def compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary))


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))


def write_store(documents: DataFrame, source: str, uri: str, params: StoreParams = StoreParams()) -> DataFrame:
    """Encode documents (doc_id, text) into files under ``uri``; returns the manifest.

    manifest: file, documents, ids, bytes, before (ids in all files before it); also written as
    Parquet to ``uri``/manifest. Encoded and compressed rows are staged once, range-partitioned
    by doc_id and streamed to files. A retried task writes files under new names and only those
    of the attempt that succeeded are in the manifest, so lost executors leave unlisted files at
    worst. Null texts are empty; rows without doc_id come first; rows with equal ids follow
    each other. An empty table gives an empty manifest.
    """
    spark = documents.sparkSession
    narrow = documents.select(F.col("doc_id").cast("long"), "text")
    dictionary = train_dictionary(narrow, source, params)
    digest = hashlib.sha256(dictionary).digest()
    fs, folder = open_store(uri)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/dictionary.zdict") as file:
        file.write(dictionary)
    shared = spark.sparkContext.broadcast((source, dictionary))
    frames = pa.schema([("doc_id", pa.int64()), ("count", pa.int32()), ("frame", pa.binary())])

    def encode(batch: pa.RecordBatch) -> dict[str, list]:
        own = encoder(shared.value[0])
        pack = compressor(shared.value[1], params.level)
        end = b"" if params.end_id is None else np.array([params.end_id], dtype=own.kind).tobytes()
        counts, packed = [], []
        for text in utf8(batch.column(1)):
            ids = own.encode(text) + end
            counts.append(len(ids) // own.kind.itemsize)
            packed.append(pack.compress(ids))
        return {"doc_id": batch.column(0), "count": counts, "frame": packed}

    rows = staged(map_rows(narrow, ["doc_id", "text"], "doc_id long, count int, frame binary", encode, frames), "frames")
    listed = pa.schema([("part", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        width = encoder(shared.value[0]).kind.itemsize
        writer, number, done = None, 0, []

        def finish(w: _Writer) -> None:
            w.close()
            done.append((task.partitionId(), w.name, len(w.index), w.ids, w.place))

        for batch in batches:
            for doc_id, count, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer and writer.place >= params.file_bytes:
                    finish(writer)
                    writer = None
                if writer is None:
                    name = f"part-{task.partitionId():06d}-{number:06d}-{task.taskAttemptId()}.dfz"
                    writer, number = _Writer(uri, name, width, digest), number + 1
                writer.add(doc_id, count, frame)
        if writer:
            finish(writer)
        if done:
            yield pa.RecordBatch.from_pydict({f.name: [d[k] for d in done] for k, f in enumerate(listed)}, schema=listed)

    # The hash deals out rows of one id, those without an id among them.
    order = [F.col("doc_id"), F.xxhash64("frame")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    files = staged(ordered.mapInArrow(write, "part int, file string, documents long, ids long, bytes long"), "files")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    manifest = files.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0))).drop("part")
    manifest.write.parquet(f"{uri}/manifest")
    return spark.read.parquet(f"{uri}/manifest")


def read_store(spark: SparkSession, uri: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files under ``uri``.

    One task reads a few files, frame by frame; the manifest says which and where each starts.
    """
    fs, folder = open_store(uri)
    with fs.open_input_stream(f"{folder}/dictionary.zdict") as file:
        dictionary = file.read()
    shared = spark.sparkContext.broadcast(dictionary)
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file, rows = TokenFile(uri, name, shared.value), []
                for k, (doc_id, first, count, _, _) in enumerate(file.index):
                    crc = zlib.crc32(file.ids(k).astype("<u4").tobytes())
                    rows.append((None if doc_id == NO_ID else doc_id, before + first, count, crc))
                file.close()
                for i in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_pydict({f.name: [r[k] for r in rows[i : i + 50_000]] for k, f in enumerate(out)}, schema=out)

    manifest = spark.read.parquet(f"{uri}/manifest").select("file", "before")
    parts = max(1, min(manifest.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.repartition(parts).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """A tokenizers file of the public tokenizers package, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op9_token_store(documents: DataFrame, source: str | None = None) -> DataFrame:
    """All documents written to a new store in the shared folder and read back from its files."""
    spark = documents.sparkSession
    uri = new_path(spark, "token-store")
    write_store(documents, source or public_tokenizer(), uri)
    return read_store(spark, uri)

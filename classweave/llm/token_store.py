"""Token ids in binary files, each document compressed by itself.

A file holds the documents of one stretch of the doc_id order. Their ids are
packed as little-endian unsigned integers of two or four bytes and compressed
one by one with zstandard under a dictionary trained on packed ids, so a short
document costs little and is read without its neighbours. Layout:

    header   8 bytes of mark, id width (1 byte), dictionary's SHA-256 (32 bytes)
    frames   one zstandard frame per document
    index    per document: flag and doc_id, offset, bytes, ids (INDEX_ROW)
    footer   offset of the index, documents (two unsigned 64-bit integers)

The dictionary stands beside the files under its hash. Files are written by
Spark's tasks after a range shuffle by doc_id; how many ids stand before a file
is summed over the list of files.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from classweave.llm.ragged import (
    KeyTable,
    Numbering,
    gather,
    held,
    offsets_of,
    piece_text,
    ragged,
    space_keys,
    text_blocks,
)
from classweave.llm.shared_files import make_folder, new_name, open_folder
from classweave.session import materialise

END_ID = 2
LEVEL = 3
# what the dictionary is trained on: documents, and packed bytes of each
SAMPLE_DOCUMENTS = 2_000
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 65_536
BLOCK_CHARS = 4_000_000
# new words encoded as one text
TOGETHER = 2_000
# pieces a worker remembers; learning one again costs as much as reading it often
KNOWN_PIECES = 700_000

# The byte-level pre-tokenizer's pattern, used for characters below
# the end of the Latin blocks, whose classes no Unicode version changes.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
LATIN_END = "\u0250"

# Fixed values of the file format.
MARK = b"CWTOKEN1"
HEADER = struct.Struct("<8sB32s")
INDEX_ROW = np.dtype([("has_id", "u1"), ("doc_id", "<i8"), ("offset", "<u8"),
                      ("bytes", "<u4"), ("ids", "<u4")])
FOOTER = struct.Struct("<QQ")

FILES_TYPE = "part int, file string, documents long, ids long"


def byte_characters() -> dict[int, int]:
    """The character that byte-level vocabularies write for each byte.

    Printable bytes stand for themselves, the others for the characters from 256
    on, in order.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


class Encoder:
    """Encodes texts with the tokenizers library, each distinct piece once.

    The byte-level pre-tokenizer never joins characters across the cuts of
    ``space_keys``, so the ids of a text are those of its pieces in turn. New
    words of old letters are encoded many at a time; other pieces of them are cut by
    the pre-tokenizer's pattern here and their distinct words given to the
    tokenizer's model; pieces with other characters
    or with special tokens go through the whole tokenizer. Other kinds of
    tokenizer encode whole texts.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.byte_level = cuts_are_safe(spec)
        self.marks = [t["content"] for t in json.loads(spec).get("added_tokens", [])]
        self.firsts = {mark[0] for mark in self.marks if mark}
        self.characters = byte_characters()
        self.table = KeyTable(self._learn, np.uint32, KNOWN_PIECES)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(
            texts, add_special_tokens=False)]

    def _word_ids(self, word: str) -> list[int]:
        shown = word.encode().decode("latin-1").translate(self.characters)
        return [token.id for token in self.model.tokenize(shown)]

    def _spaced_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, each with a space before it, and where each starts.

        Spaces cut them apart again, so many are encoded as one text.
        """
        found, sizes = [], []
        for low in range(0, len(words), TOGETHER):
            own = words[low:low + TOGETHER]
            done = self.tokenizer.encode(" " + " ".join(own), add_special_tokens=False)
            size = np.bincount(np.array(done.word_ids, np.int64), minlength=len(own))
            if len(size) != len(own) or not size.all():
                raise ValueError("the tokenizer cuts words of letters")
            found.append(np.array(done.ids, np.uint32))
            sizes.append(size)
        return (offsets_of(np.concatenate([*sizes, np.zeros(0, np.int64)])),
                np.concatenate([*found, np.zeros(0, np.uint32)]))

    def _learn(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        spaced, words, runs, whole = Numbering(), Numbering(), [], []
        for i, key in enumerate(keys):
            if key.isalpha() and is_old(key):
                # below zero, as the other words are numbered first
                runs.append((~spaced[key],))
                continue
            piece = piece_text(key)
            if is_old(piece) and not (any(first in piece for first in self.firsts) and any(
                    mark in piece for mark in self.marks)):
                runs.append([~spaced[w[1:]] if w[0] == " " and w[1:].isalpha() else words[w]
                             for w in SPLIT(piece)])
            else:
                runs.append(())
                whole.append((i, piece))
        word_starts, word_ids = ragged(map(self._word_ids, words), np.uint32)
        more_starts, more_ids = self._spaced_ids(list(spaced))
        word_starts = np.concatenate([word_starts, word_starts[-1] + more_starts[1:]])
        starts, chosen = ragged(runs, np.int64)
        chosen = np.where(chosen < 0, len(words) + ~chosen, chosen)
        ids, ends = gather(word_starts, np.concatenate([word_ids, more_ids]), chosen)
        starts = ends[starts]
        if not whole:
            return starts, ids
        parts = np.split(ids, starts[1:-1])
        for (i, _), own in zip(whole, self._encode([piece for _, piece in whole])):
            parts[i] = np.array(own, np.uint32)
        return (offsets_of(np.fromiter(map(len, parts), np.int64, len(parts))),
                np.concatenate(parts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.byte_level:
            return self.table.read(space_keys(texts))
        return ragged(self._encode(texts.to_pylist()), np.uint32)


def is_old(text: str) -> bool:
    """Whether all characters stand below the end of the Latin blocks."""
    return text.isascii() or max(text) < LATIN_END


def cuts_are_safe(spec: str) -> bool:
    """Whether the tokenizer is plain byte-level BPE without marks with spaces."""
    parts = json.loads(spec)
    pre = parts.get("pre_tokenizer") or {}
    return (parts.get("normalizer") is None and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and parts["model"].get("type") == "BPE"
            and not any(set(t["content"]) & set(" \n") or t.get("lstrip") or t.get("rstrip")
                        or t.get("single_word") for t in parts.get("added_tokens", [])))


def worker_encoder(spec: str) -> Encoder:
    key = hashlib.sha256(spec.encode()).hexdigest()
    return held(("token store", key), lambda: Encoder(spec))


def id_width(spec: str) -> int:
    return 2 if Tokenizer.from_str(spec).get_vocab_size() <= 1 << 16 else 4


def encode_texts(spec: str, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
    """Ids of each text with the end id; null counts as empty."""
    coder = worker_encoder(spec)
    for block in text_blocks(texts, BLOCK_CHARS):
        starts, ids = coder.encode(block)
        for low, high in zip(starts.tolist(), starts[1:].tolist()):
            yield np.append(ids[low:high], np.uint32(end_id))


def train_dictionary(docs: DataFrame, spec: str, end_id: int = END_ID) -> bytes:
    """A dictionary from packed ids of ``SAMPLE_DOCUMENTS`` documents.

    The documents are those with the smallest hash of their id. Too small a
    sample gives no dictionary, and frames are then compressed without one.
    """
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    width = id_width(spec)

    def pack(texts: pa.Array) -> pa.Array:
        return pa.array((ids.astype(f"<u{width}").tobytes()[:SAMPLE_BYTES]
                         for ids in encode_texts(spec, texts, end_id)), pa.binary())

    rows = docs.select("doc_id", "text").join(
        F.broadcast(chosen), "doc_id").select(  # at most SAMPLE_DOCUMENTS ids
        "doc_id", F.arrow_udf(pack, "binary")(F.col("text")).alias("raw")
    ).dropDuplicates(["doc_id"]).collect()
    samples = [bytes(r.raw) for r in sorted(rows, key=lambda r: r.doc_id)]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 10)
    if len(samples) < 20 or size < 1024:
        return b""
    return zstandard.train_dictionary(size, samples).as_bytes()


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()


def dictionary_file(folder: str, digest: bytes) -> str:
    return f"{folder}/{digest.hex()}.dict"


class FileWriter:
    """Writes one file of the format; documents come in order."""

    def __init__(self, out, width: int, dictionary: bytes):
        self.out, self.width = out, width
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.engine = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        self.rows: list[tuple] = []
        self.at = out.write(HEADER.pack(MARK, width, dictionary_hash(dictionary)))
        self.ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.engine.compress(ids.astype(f"<u{self.width}").tobytes())
        self.out.write(frame)
        self.rows.append((doc_id is not None, doc_id or 0, self.at, len(frame), len(ids)))
        self.at += len(frame)
        self.ids += len(ids)

    def close(self) -> None:
        self.out.write(np.array(self.rows, INDEX_ROW).tobytes())
        self.out.write(FOOTER.pack(self.at, len(self.rows)))
        self.out.close()


class FileReader:
    """Reads one file of the format; any document alone, by its row."""

    def __init__(self, source, dictionary_of: Callable[[bytes], bytes]):
        self.source = source
        mark, self.width, digest = HEADER.unpack(source.read(HEADER.size))
        if mark != MARK:
            raise ValueError("not a token file")
        dictionary = dictionary_of(digest)
        if dictionary_hash(dictionary) != digest:
            raise ValueError("the dictionary is not the one the file was written with")
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.engine = zstandard.ZstdDecompressor(dict_data=shared)
        source.seek(source.size() - FOOTER.size)
        at, count = FOOTER.unpack(source.read(FOOTER.size))
        source.seek(at)
        self.index = np.frombuffer(source.read(count * INDEX_ROW.itemsize), INDEX_ROW)

    def ids(self, row: int) -> np.ndarray:
        entry = self.index[row]
        self.source.seek(int(entry["offset"]))
        raw = self.engine.decompress(self.source.read(int(entry["bytes"])))
        found = np.frombuffer(raw, f"<u{self.width}")
        if len(found) != entry["ids"]:
            raise ValueError("a document's ids do not fit the index")
        return found


def write_store(docs: DataFrame, spec: str, folder: str,
                end_id: int = END_ID) -> DataFrame:
    """Write ``doc_id, text`` in ascending doc_id order; return the list of files.

    Null ids come first; equal ids are ordered by their text, null first. The
    list has each file's place in the order and the ids before it.
    """
    spark: SparkSession = docs.sparkSession
    make_folder(folder)
    dictionary = train_dictionary(docs, spec, end_id)
    system, path = open_folder(folder)
    digest = dictionary_hash(dictionary)
    with system.open_output_stream(
            dictionary_file(path, digest), compression=None) as out:
        out.write(dictionary)
    shared = spark.sparkContext.broadcast((spec, dictionary))
    width = id_width(spec)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        own_spec, own_dictionary = shared.value
        own, base = open_folder(folder)
        name = new_name("tokens", ".bin")
        writer = FileWriter(own.open_output_stream(
            f"{base}/{name}", compression=None), width, own_dictionary)
        for batch in chain([first], batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode_texts(
                    own_spec, batch.column("text"), end_id)):
                writer.add(doc_id, ids)
        writer.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()),
             pa.array([f"{folder}/{name}"]), pa.array([len(writer.rows)], pa.int64()),
             pa.array([writer.ids], pa.int64())],
            names=["part", "file", "documents", "ids"])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id") \
        .sortWithinPartitions("doc_id", "text")
    files = materialise(ordered.mapInArrow(write, FILES_TYPE))
    # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_store(files: DataFrame, folder: str, digest_only: bool = False) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids_crc32`` and ids.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = open_folder(folder)

        def dictionary_of(digest: bytes) -> bytes:
            with own.open_input_stream(
                    dictionary_file(base, digest), compression=None) as stream:
                return stream.read()

        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(),
                                   batch.column("start").to_pylist()):
                with own.open_input_file(open_folder(file)[1]) as source:
                    reader = FileReader(source, dictionary_of)
                    for low in range(0, len(reader.index), 500):
                        rows = []
                        for row in range(low, min(low + 500, len(reader.index))):
                            ids, entry = reader.ids(row), reader.index[row]
                            rows.append((
                                int(entry["doc_id"]) if entry["has_id"] else None,
                                start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()),
                                None if digest_only else ids.astype(np.int64)))
                            start += len(ids)
                        yield _batch(rows, digest_only)

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"
    n = max(1, min(files.count(), 10_000))
    return files.select("file", "start").repartition(n).mapInArrow(
        read, kind if digest_only else kind + ", ids array<long>")


def _batch(rows: list[tuple], digest_only: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    if digest_only:
        names, kinds, rows = names[:4], kinds[:4], [r[:4] for r in rows]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)

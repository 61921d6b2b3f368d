"""Binary token files: frequency-ranked ids in byte-aligned codes with separate control bytes."""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Recent, cut, few, map_batches, running_sum, shared_dir, slices

MAGIC = b"TFV2"
HEAD = struct.Struct("<4sIQQQ")
#: Ids after which a block is closed, and bytes after which a file is.
BLOCK_IDS = 1_000_000
FILE_BYTES = 32_000_000
#: Pieces of text whose ids one Python worker remembers, bytes of the longest of them, and bytes of text that it cuts at a time.
CACHE = 250_000
KEPT = 256
SLICE_BYTES = 8_000_000
#: Bytes of its ids by which a row that repeats a doc_id is ordered.
HEAD_BYTES = 64
#: In a folder of token files: the table of ids by rank, and folders of the files and of the ids before each.
RANKS, FILES, STARTS = "ranks.u32", "tokens", "starts"
#: For each control byte the lengths of its four codes.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
#: Kinds of bytes: ASCII letters, digits, marks, the apostrophe, ASCII white space, bytes of longer characters, those that may begin longer white space, other control characters.
LETTER, DIGIT, MARK, QUOTE, SPACE, LONG, LEAD, CONTROL = range(8)
KIND = np.full(256, LONG, np.uint8)
KIND[:128] = [LETTER if c.isalpha() else DIGIT if c.isdigit() else QUOTE if c == "'" else SPACE if c in "\t\n\v\f\r " else MARK if c.isprintable() else CONTROL for c in map(chr, range(128))]
KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = LEAD
#: Pieces that keep their ids when line breaks stand around them, and how many of these are one text for the library.
_LINE = re.compile(r" ?\S(?:[^\n]*\S)?")
LINES = 128


def piece_starts(raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each byte of UTF-8 texts that begin at the places ``texts``.

    Pieces begin only where the tokenizer's own do, and each has the ids alone that it has in its text: white space after
    an ASCII letter, digit or mark; a space before what is surely none; what follows a line break that is the only white
    space there; a change between letters, digits and marks, except after an apostrophe (contractions). Elsewhere a piece
    may hold several of the tokenizer's own.
    """
    kind = KIND[raw]
    solid, seen = kind <= QUOTE, (kind != SPACE) & (kind != LEAD)
    seen[texts] = False  # not from the text before
    starts = np.zeros(len(raw), bool)
    starts[1:] = solid[:-1] & (kind[1:] == SPACE)
    starts[:-1] |= (raw[:-1] == 0x20) & seen[1:]
    starts[2:] |= solid[:-2] & (raw[1:-1] == 0x0A) & seen[2:]
    group = np.minimum(kind, MARK)
    starts[1:] |= (kind[:-1] <= MARK) & solid[1:] & (group[:-1] != group[1:])
    latin = (raw[:-2] == 0xC3) & (raw[1:-1] != 0x97) & (raw[1:-1] != 0xB7)  # letters from U+00C0 to U+00FF
    starts[2:] |= latin & (kind[2:] >= DIGIT) & (kind[2:] <= QUOTE)
    starts[texts] = True
    return starts


class ByteBPE:
    """The tokenizers library behind a cache of pieces, for files with byte-level pre-tokenisation."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = Recent(CACHE)
        self.line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def _learn(self, pieces: list[bytes]) -> None:
        """Ids of new pieces: many are encoded as the lines of one text, as the library spends more on a text than on a word."""
        lines, others = [], []
        for p in pieces:
            text = p.decode()
            (lines if _LINE.fullmatch(text) and not any(m in text for m in self.marks) else others).append(text)
        if len(self.line_break) != 1 or any("\n" in m for m in self.marks):
            lines, others = [], lines + others
        groups = ["\n".join(lines[i : i + LINES]) + "\n" for i in range(0, len(lines), LINES)]
        encoded = [np.asarray(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)]
        if encoded:
            flat = np.concatenate(encoded)
            raw, width = flat.tobytes(), self.dtype.itemsize
            ends = np.flatnonzero(flat == self.line_break[0])
            start = 0
            for text, end in zip(lines, (ends * width).tolist(), strict=True):
                self.cache[text.encode()] = raw[start:end]
                start = end + width
        for text, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            self.cache[text.encode()] = np.asarray(e.ids, self.dtype).tobytes()

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """Ids of each text, packed as ``dtype``, with ``end`` after them. Null counts as empty; texts with a special token's string go whole to the library.

        Texts are cut where they lie, equal pieces are found by Arrow, and Python meets each distinct one once.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        starts = piece_starts(raw, at[at < len(raw)])
        for mark in self.marks:
            for i in np.flatnonzero(pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)):
                starts[at[i] + 1 : at[i + 1]] = False
        first = np.flatnonzero(starts).astype(np.int32)
        bounds = np.append(first, np.int32(len(raw)))
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        ids = list(map(self.cache.get, pieces))
        lacking = [k for k, i in enumerate(ids) if i is None]
        self._learn(self.cache.missing({pieces[k] for k in lacking}))
        for k in lacking:
            ids[k] = self.cache[pieces[k]] if len(pieces[k]) <= KEPT else self.cache.pop(pieces[k])
        before = np.searchsorted(first, at)  # pieces before each text
        order = np.insert(coded.indices.to_numpy(), before[1:], len(pieces))
        packed = pa.array([*ids, end], pa.binary()).take(pa.array(order))
        offsets = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, 4 * packed.offset)[before + np.arange(len(before))]
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), packed.buffers()[2]])


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_codes(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes): each rank in one to four bytes, its length in two control bits."""
    ranks = ranks.astype(np.uint32)
    extra = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    wide = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = wide[np.arange(4) <= extra[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_codes(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Ranks again: lengths by table lookup, positions by a running sum, bytes by gathers."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    at = np.cumsum(lengths) - lengths
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_block(doc_ids: list[int | None], ids: list[np.ndarray], rank_of: np.ndarray) -> bytes:
    """One block: header, which document ids are null (a bit each), document ids, counts, control bytes, data bytes."""
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    control, data = encode_codes(rank_of[flat])
    head = HEAD.pack(MAGIC, len(doc_ids), len(flat), len(control), len(data))
    null = np.packbits([i is None for i in doc_ids])
    counts = np.fromiter(map(len, ids), "<u4", len(ids))
    return b"".join((head, null.tobytes(), np.asarray([i or 0 for i in doc_ids], "<i8").tobytes(), counts.tobytes(), control, data))


def unpack_blocks(content: bytes, id_of: np.ndarray):
    """(document ids, which of them are null, counts, ids) of each block of a file."""
    at = 0
    while at < len(content):
        magic, docs, n, c, d = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEAD.size
        null = np.unpackbits(np.frombuffer(content, np.uint8, -(-docs // 8), at), count=docs).astype(bool)
        at += -(-docs // 8)
        doc_ids = np.frombuffer(content, "<i8", docs, at)
        counts = np.frombuffer(content, "<u4", docs, at + 8 * docs)
        at += 12 * docs
        yield doc_ids, null, counts, id_of[decode_codes(content[at : at + c], content[at + c : at + c + d], n)]
        at += c + d


def encode(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """``(doc_id, ids)`` of every whole text with ``end_id`` appended, packed in 2 or 4 bytes an id."""

    def run(batches):
        bpe = byte_bpe(path)
        end = np.asarray([end_id], bpe.dtype).tobytes()
        for batch in batches:
            for part in slices(batch, budget=SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), bpe.encode_column(part.column("text"), end)], names=["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids binary")


def frequencies(encoded: DataFrame, vocabulary: int, dtype: np.dtype) -> DataFrame:
    """``(id, n)`` over all documents; a task sends at most one row for each id of the vocabulary."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_buffer(), dtype), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return map_batches(encoded.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(docs: DataFrame, path: str, out: str, end_id: int = 0) -> DataFrame:
    """Encode ``docs`` and write token files below ``out`` in ascending doc_id order; returns ``(file, n_docs, n_ids)``.

    The folder says all that a reader needs: ``tokens/*.tfv``, the table of ids by rank in ``ranks.u32``
    (little-endian, one for each id of the vocabulary), and in ``starts`` a small Parquet table
    ``(file, before)`` of the ids before each file.

    Documents are encoded once into a durable table; its ids are counted (a sum for each id of the
    vocabulary, the only thing that reaches the driver), then it is dealt by ranges of doc_id and each
    task writes its files under a temporary name and renames them, so a repeated task replaces equal
    bytes by equal bytes. Null doc_ids come first; rows that repeat a doc_id are all written, in the
    order of their first ids and then of their place, so that such rows too are dealt over tasks.
    """
    bpe = byte_bpe(path)
    size, dtype = bpe.tokenizer.get_vocab_size(), bpe.dtype
    rows = encode(docs, path, end_id).select("*", F.substring("ids", 1, HEAD_BYTES).alias("head"), F.monotonically_increasing_id().alias("place"))
    encoded = cut(rows)
    by_count = frequencies(encoded, size, dtype).orderBy(F.desc("n"), "id").toPandas()["id"].to_numpy(np.int64)
    id_of = np.concatenate([by_count, np.setdiff1d(np.arange(size), by_count)]).astype(np.uint32)
    rank_of = np.empty(size, np.uint32)
    rank_of[id_of] = np.arange(size, dtype=np.uint32)
    _write(f"{out}/{RANKS}", id_of.astype("<u4").tobytes())

    def run(batches):
        store, folder = fs.FileSystem.from_uri(f"{out}/{FILES}")
        store.create_dir(folder)
        task, files = TaskContext.get(), 0
        done, blocks, doc_ids, ids, held, n_docs, n_ids = [], [], [], [], 0, 0, 0

        def close_block():
            nonlocal held, doc_ids, ids
            if doc_ids:
                blocks.append(pack_block(doc_ids, ids, rank_of))
                doc_ids, ids, held = [], [], 0

        def close_file():
            nonlocal blocks, n_docs, n_ids, files
            close_block()
            if blocks:
                name = f"part-{task.partitionId():06d}-{files:05d}.tfv"
                draft = f"{folder}/.{name}.{task.taskAttemptId()}"
                with store.open_output_stream(draft) as f:
                    for b in blocks:
                        f.write(b)
                store.move(draft, f"{folder}/{name}")
                done.append((name, n_docs, n_ids))
                files, blocks, n_docs, n_ids = files + 1, [], 0, 0

        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                one = np.frombuffer(raw.as_buffer(), dtype)
                doc_ids.append(doc_id)
                ids.append(one)
                held, n_docs, n_ids = held + len(one), n_docs + 1, n_ids + len(one)
                if held >= BLOCK_IDS:
                    close_block()
                    if sum(map(len, blocks)) >= FILE_BYTES:
                        close_file()
        close_file()
        if done:
            name, docs_, ids_ = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(docs_, pa.int64()), pa.array(ids_, pa.int64())], names=["file", "n_docs", "n_ids"])

    order = ("doc_id", "head", "place")
    ordered = encoded.repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = cut(ordered.mapInArrow(run, "file string, n_docs long, n_ids long"))
    hundred = F.substring("file", 1, 9)  # of the partitions that the files are named after
    running_sum(manifest, "file", hundred, F.col("n_ids"), "before").select("file", "before").write.parquet(f"{out}/{STARTS}")
    return manifest


def _write(path: str, content: bytes) -> None:
    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name.rsplit("/", 1)[0])
    with store.open_output_stream(name) as f:
        f.write(content)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, position, doc_id, start, ids)`` of every document in a folder of token files; ``start``: ids of all documents before it.

    Only the folder is needed: see :func:`write_files` for what lies in it.
    """

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{base}/{RANKS}") as f:
            id_of = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                position = at = 0
                for doc_ids, null, counts, ids in unpack_blocks(memoryview(content.as_buffer()), id_of):
                    ends = np.cumsum(counts, dtype=np.int64)
                    n = len(doc_ids)
                    packed = ids.astype("<u4").tobytes()
                    parts = [packed[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path.rsplit("/", 1)[-1]] * n), pa.array(np.arange(position, position + n)), pa.array(doc_ids, mask=null), pa.array(at + ends - counts), pa.array(parts, pa.binary())],
                        names=["file", "position", "doc_id", "at", "ids"],
                    )
                    position, at = position + n, at + int(counts.sum())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tfv").load(f"{folder}/{FILES}").select("path", "content")
    read = files.mapInArrow(run, "file string, position long, doc_id long, at long, ids binary")
    starts = few(spark.read.schema("file string, before long").parquet(f"{folder}/{STARTS}"))  # a row for each 32 MB
    return read.join(starts, "file").select("file", "position", "doc_id", (F.col("before") + F.col("at")).alias("start"), "ids")


def digests(documents: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of what :func:`read_files` gives, ids left behind."""

    def run(batches):
        for batch in batches:
            raw = [i.as_buffer() for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array([i.size // 4 for i in raw], pa.int64()), pa.array([zlib.crc32(i) for i in raw], pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return documents.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files it was written to.

    ``start`` counts the ids of all documents before it in doc_id order. A null text counts as empty and so
    is the end id alone; repeated rows each have a place of their own; an empty table writes no token
    files. Other columns are not read.
    """
    spark = docs.sparkSession
    out = shared_dir(spark)
    if write_files(docs, path, out, end_id).isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return digests(read_files(spark, out))

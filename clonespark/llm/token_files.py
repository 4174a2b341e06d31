"""Token ids as Arrow files of equal sequences that can be mapped into memory.

Texts are encoded with a byte-level BPE of the tokenizers library, each followed by an end
id, and written in ascending id order. The range partitions of the order become one pair of Arrow IPC files each:

* ``*.tokens.arrow``: batches of ``BATCH`` rows, ``ids`` (fixed-size list of ``sequence`` unsigned integers, 16 bits
  wide where the vocabulary allows) and ``mask`` (fixed-size list of bits, false in the padding). Buffers
  are not compressed, so row ``k`` is a view of the mapped file: batch ``k // BATCH``, row ``k % BATCH``.
* ``*.documents.arrow``: ``doc_id``, ``start`` (tokens before it in this file) and ``n_tokens``.

Only the last sequence of a file is padded. A manifest holds one row per pair of files; the running
sum of its tokens places the files in the whole stream. Files carry names of their own
per attempt, and only those of the attempt that finished are named by the manifest, so lost
executors and repeated tasks leave no trace in it.

Encoding works on words: between two characters that are surely no white space, a single blank starts a
token of its own in the pattern of the vocabulary, so what lies between such blanks is encoded without regard to its
neighbours. The library is given each distinct word of a piece of text once, and none that the worker knows
already; the ids are put together by array operations.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ..session import checkpoint_folder
from .kernels import U, distinct_keys, segment_hashes, slices, text_bytes
from .storage import stored

#: Tokens of one sequence, and sequences of one record batch.
SEQUENCE, BATCH = 2048, 64
#: Bytes of text of one range partition and of one piece that is encoded at once.
FILE_TEXT, PIECE = 24 << 20, 2 << 20
#: Bytes of new words that are encoded as one text.
JOINT = 8 << 10
#: Bytes that the words kept by one Python worker may take; beyond them it begins anew.
CACHE = 128 << 20
MANIFEST = "shard int, tokens_file string, documents_file string, n_documents long, n_tokens long, n_sequences long"
ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Growing:
    """An array that is appended to; its room doubles when it is full."""

    def __init__(self, *begin: int, kind: type):
        self.room, self.size = np.array(begin, kind), len(begin)

    def append(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.room):
            wider = np.empty(2 * (self.size + len(values)), self.room.dtype)
            wider[: self.size] = self.values
            self.room = wider
        self.room[self.size : self.size + len(values)] = values
        self.size += len(values)

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.size]


class WordEncoder:
    """Ids of whole texts, by way of their distinct words.

    Words that were met before are kept with their bytes and found by hash; bytes are always compared. New words are put
    behind one another and encoded together, which changes no id, since a word begins with a blank between visible
    characters. The lengths of the tokens in bytes tell which ids belong to which word.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(model)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.width[number] = len(token)  # one character stands for one byte
        for number, token in self.library.get_added_tokens_decoder().items():
            self.width[number] = len(token.content.encode())
        self.forget()

    def forget(self) -> None:
        self.keys, self.places = np.zeros(0, U), np.zeros(0, np.int64)
        self.letters, self.letter_bounds = Growing(kind=np.uint8), Growing(0, kind=np.int64)
        self.pool, self.bounds = Growing(kind=np.uint32), Growing(0, kind=np.int64)

    @property
    def size(self) -> int:
        return len(self.letters.room) + 4 * len(self.pool.room) + 32 * len(self.keys)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts behind one another (nulls are empty), and the bounds of each."""
        data, offsets = text_bytes(texts)
        starts = word_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data)).astype(np.int64)
        keys, heads, of = distinct_keys(segment_hashes(data, starts, ends))
        heads, of = apart(data, starts, ends, heads, of)
        place = self._find(keys, data, starts[heads], ends[heads])
        bounds = self.bounds.values
        sizes = (bounds[place + 1] - bounds[place])[of]
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(bounds[place][of] - total[:-1], sizes) + np.arange(total[-1])
        return self.pool.values[at], total[np.searchsorted(starts, offsets)]

    def _find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place in the pool of each word; the first have the ascending ``keys``, others share the hash of one of them."""
        if self.size > CACHE:
            self.forget()
        place = np.full(len(starts), -1)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == keys)
            old = self.places[at[hit]]
            own = self.letter_bounds.values
            same = equal_bytes(data, starts[hit], ends[hit], self.letters.values, own[old], own[old + 1])
            place[hit[same]] = old[same]
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            ids, bounds = self._by_library(data, starts[fresh], ends[fresh])
            place[fresh] = self.bounds.size - 1 + np.arange(len(fresh))
            self.letter_bounds.append(self.letters.size + np.cumsum(ends[fresh] - starts[fresh]))
            self.letters.append(data[spans(starts[fresh], ends[fresh])])
            self.bounds.append(self.pool.size + bounds[1:])
            self.pool.append(ids)
            kept = fresh[fresh < len(keys)]  # in order; a key that is there already belongs to another word
            at = np.searchsorted(self.keys, keys[kept])
            if len(self.keys):
                new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys[kept]
                kept, at = kept[new], at[new]
            self.keys, self.places = np.insert(self.keys, at, keys[kept]), np.insert(self.places, at, place[kept])
        return place

    def _by_library(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen, two = visible(data)
        closed = seen[ends - 1] | ((ends - starts > 1) & two[np.maximum(ends - 2, 0)])
        joint = (ends - starts > 1) & (data[starts] == 32) & (seen | two)[np.minimum(starts + 1, len(data) - 1)] & closed
        sizes = np.where(joint, ends - starts, 0)
        flat = data[spans(starts[joint], ends[joint])]
        edges = np.concatenate([[0], np.cumsum(sizes[joint])])
        cuts = np.unique(np.append(edges[np.searchsorted(edges, np.arange(0, edges[-1], JOINT))], edges[-1]))
        raw = flat.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        single = np.flatnonzero(~joint)
        texts += [data[a:b].tobytes().decode() for a, b in zip(starts[single].tolist(), ends[single].tolist(), strict=True)]
        coded = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        together, alone = coded[: len(cuts) - 1], coded[len(cuts) - 1 :]
        ids = np.concatenate([np.zeros(0, np.uint32), *together])
        last = np.searchsorted(np.cumsum(self.width[ids]), edges[1:])  # the token that ends where the word does
        counts = np.zeros(len(starts), np.int64)
        counts[joint] = np.diff(last, prepend=-1)
        counts[single] = [len(c) for c in alone]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(bounds[-1], np.uint32)
        out[spans(bounds[:-1][joint], bounds[1:][joint])] = ids
        out[spans(bounds[:-1][single], bounds[1:][single])] = np.concatenate([np.zeros(0, np.uint32), *alone])
        return out, bounds


_LAST: dict[str, WordEncoder] = {}


def encoder_of(model: str) -> WordEncoder:
    """The worker's encoder, which keeps its words from task to task."""
    if model not in _LAST:
        _LAST.clear()
        _LAST[model] = WordEncoder(model)
    return _LAST[model]


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the half-open spans, behind one another."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def equal_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Which segments of ``data`` have the bytes of the segments of ``other`` beside them."""
    same = ends - starts == other_ends - other_starts
    step = 1 << 17
    for begin in range(0, len(starts), step):
        part = np.flatnonzero(same[begin : begin + step]) + begin
        unequal = data[spans(starts[part], ends[part])] != other[spans(other_starts[part], other_ends[part])]
        edges = np.concatenate([[0], np.cumsum(ends[part] - starts[part])])
        same[part] = np.diff(np.concatenate([[0], np.cumsum(unequal)])[edges]) == 0
    return same


def visible(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of surely visible ASCII characters, and of the first bytes of surely visible characters of two bytes."""
    return (data > 32) & (data < 127), (data >= 0xC3) & (data <= 0xDF)


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin: at texts, and at single blanks between characters that are surely visible.

    Surely visible are the ASCII characters from 33 to 126 and characters of two bytes whose first is C3 to
    DF; white space of Unicode is outside of both.
    """
    seen, two = visible(data)
    cut = np.zeros(len(data), bool)
    if len(data) > 2:
        before = seen.copy()
        before[1:] |= two[:-1]  # the second byte of two
        cut[1:-1] = (data[1:-1] == 32) & before[:-2] & (seen | two)[2:]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    cut[last] = False  # a blank at the end of a text has nothing behind it
    cut[begin] = True
    return np.flatnonzero(cut)


def apart(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words whose bytes are not those of the first word with their hash get a number of their own."""
    first = heads[of]
    differs = np.zeros(len(starts), bool)
    again = np.flatnonzero(first != np.arange(len(starts)))
    differs[again] = ~equal_bytes(data, starts[again], ends[again], data, starts[first[again]], ends[first[again]])
    odd = np.flatnonzero(differs)
    if len(odd):
        of = of.copy()
        of[odd] = len(heads) + np.arange(len(odd))
        heads = np.concatenate([heads, odd])
    return heads, of


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, as every executor reaches it, and the path in it."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class SequenceWriter:
    """Appends ids to a file of fixed-size sequences; holds one batch at most."""

    def __init__(self, sink, width: np.dtype, sequence: int, batch: int):
        self.sequence, self.batch, self.width = sequence, batch, width
        kind = pa.from_numpy_dtype(width)
        self.schema = pa.schema([pa.field("ids", pa.list_(kind, sequence)), pa.field("mask", pa.list_(pa.bool_(), sequence))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held, self.n_held, self.n_tokens, self.n_sequences = [], 0, 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.width))
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        whole = self.sequence * self.batch
        if self.n_held >= whole:
            flat = np.concatenate(self.held)
            full = len(flat) // whole * whole
            for begin in range(0, full, whole):
                self._write(flat[begin : begin + whole], whole)
            self.held, self.n_held = [flat[full:]], len(flat) - full

    def _write(self, ids: np.ndarray, real: int) -> None:
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.sequence), pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < real), self.sequence)]
        self.out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.n_sequences += len(arrays[0])

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.sequence) * self.sequence, self.width)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.out.close()


def write_token_files(docs: DataFrame, model: str, end_id: int = 2, folder: str | None = None, sequence: int = SEQUENCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all texts, write the files below ``folder`` and return their manifest, with the first token and sequence of each.

    ``folder`` is one that every executor reaches (a URI or a path; the checkpoint folder by default) and may be kept:
    the manifest is written beside the files. Rows are ordered by id, then by a hash of the text; rows without an
    id come last. Null texts are empty and have the end id only. An empty table has an empty manifest. Other
    columns are ignored. Returns ``shard, tokens_file, documents_file, n_documents, n_tokens, n_sequences,
    first_token, first_sequence``; shards without documents are left out.
    """
    spark = docs.sparkSession
    folder = f"{(folder or checkpoint_folder(spark)).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    width = np.dtype(np.uint16) if _vocabulary(model) <= 1 << 16 and end_id < 1 << 16 else np.dtype(np.uint32)

    def write(batches):
        shard = TaskContext.get().partitionId()
        store, path = store_of(folder)
        encoder, writer, documents, sinks, names = None, None, None, [], []
        n = 0
        for batch in batches:
            for piece in slices(batch, "text", PIECE):
                if writer is None:
                    encoder = encoder_of(model)
                    stem = f"part-{shard:06d}-{uuid.uuid4().hex}"
                    names = [f"{stem}.tokens.arrow", f"{stem}.documents.arrow"]
                    store.create_dir(path, recursive=True)
                    sinks = [store.open_output_stream(f"{path}/{name}") for name in names]
                    writer = SequenceWriter(sinks[0], width, sequence, BATCH)
                    documents = pa.ipc.new_file(sinks[1], ROWS)
                ids, bounds = encoder.encode(piece.column("text"))
                sizes = np.diff(bounds) + 1
                begin = writer.n_tokens + np.concatenate([[0], np.cumsum(sizes)])[:-1]
                writer.add(np.insert(ids, bounds[1:], end_id))
                documents.write_batch(pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(begin), pa.array(sizes)], schema=ROWS))
                n += piece.num_rows
        if writer is not None:
            writer.close()
            documents.close()
            for sink in sinks:
                sink.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "tokens_file": pa.array([f"{folder}/{names[0]}"]), "documents_file": pa.array([f"{folder}/{names[1]}"]),
                "n_documents": pa.array([n]), "n_tokens": pa.array([writer.n_tokens]), "n_sequences": pa.array([writer.n_sequences]),
            })

    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // FILE_TEXT))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("row")]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    written = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(write, MANIFEST)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = stored(written, "token-files")
    manifest = manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("first_sequence", F.coalesce(F.sum("n_sequences").over(before), F.lit(0)))
    path = f"{folder}/manifest"
    manifest.write.parquet(path)
    return spark.read.schema(manifest.schema).parquet(path)


def _vocabulary(model: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(model).get_vocab_size(with_added_tokens=True)


class TokenFile:
    """Random access to the sequences of one token file. Local files are mapped, and what is returned are views of the mapping."""

    def __init__(self, uri: str):
        store, path = store_of(uri)
        self.source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.sequence = self.reader.schema.field("ids").type.list_size

    def batch(self, k: int) -> tuple[np.ndarray, pa.RecordBatch]:
        """All ids of batch ``k`` as one array, and the batch."""
        batch = self.reader.get_batch(k)
        column = batch.column("ids")
        return column.values.to_numpy()[column.offset * self.sequence : (column.offset + len(column)) * self.sequence], batch

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view) and mask of sequence ``k`` of this file."""
        ids, batch = self.batch(k // BATCH)
        row = k % BATCH
        return ids[row * self.sequence : (row + 1) * self.sequence], batch.column("mask")[row].values.to_numpy(zero_copy_only=False)

    def tokens(self, begin: int, end: int) -> np.ndarray:
        """Ids from place ``begin`` to ``end`` of the file; a view where they lie in one batch."""
        whole = BATCH * self.sequence
        parts = [self.batch(k)[0][max(begin - k * whole, 0) : end - k * whole] for k in range(begin // whole, -(-end // whole))]
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def read_documents(manifest: DataFrame) -> DataFrame:
    """``doc_id, start`` (in the whole stream), ``n_tokens`` and ``ids_crc32`` of every document, from the files."""

    def read(batches):
        for batch in batches:
            for tokens_file, documents_file, first in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids = TokenFile(tokens_file)
                store, path = store_of(documents_file)
                with store.open_input_file(path) as source:
                    reader = pa.ipc.open_file(source)
                    for k in range(reader.num_record_batches):
                        rows = reader.get_batch(k)
                        start, size = rows.column("start").to_numpy(), rows.column("n_tokens").to_numpy()
                        if not len(start):
                            continue
                        wide = ids.tokens(int(start[0]), int(start[-1] + size[-1])).astype("<u4")
                        at = start - start[0]
                        sums = [zlib.crc32(wide[a:b]) for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [rows.column("doc_id"), pa.array(start + first), rows.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                        )

    spread = manifest.select("tokens_file", "documents_file", "first_token")
    return spread.repartition(max(1, spread.sparkSession.sparkContext.defaultParallelism * 4)).mapInArrow(read, DOCUMENTS)


def read_sequences(manifest: DataFrame) -> DataFrame:
    """``sequence`` (number in the whole stream), ``ids`` and ``mask`` of every sequence."""

    def read(batches):
        for batch in batches:
            for tokens_file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(tokens_file)
                for k in range(file.reader.num_record_batches):
                    _, rows = file.batch(k)
                    number = first + k * BATCH + np.arange(rows.num_rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number), rows.column("ids").cast(pa.list_(pa.int64())), rows.column("mask").cast(pa.list_(pa.bool_()))], names=["sequence", "ids", "mask"]
                    )

    spread = manifest.select("tokens_file", "first_sequence")
    return spread.repartition(max(1, spread.sparkSession.sparkContext.defaultParallelism * 4)).mapInArrow(read, "sequence long, ids array<long>, mask array<boolean>")

"""Token ids of whole texts, and files that hold them at a fixed number of bits an id.

File layout (little endian; the payload stands last, so a reader needs one look at the head for random access)::

    magic "GRSTTOK1" | u32 bits an id | u32 ids a block | u64 documents | u64 ids | u64 blocks
    i64 doc_id of each document | u8 whether it is present | u64 ids of each document
    u64 byte offset of each block in the payload
    payload: block after block, each id in ``bits`` bits, lowest bit first, each block padded to a whole byte
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm._shared import shared_dir

MAGIC = b"GRSTTOK1"
#: Files whose starts are broadcast to the readers, at most.
BROADCAST_FILES = 1_000_000
HEAD = struct.Struct("<8sIIQQQ")
_ENCODERS: dict[tuple, Encoder] = {}


#: Latin-1 bytes in lower case with every white space as a blank; and their kinds: letters and digits, stops, blanks, others.
LOWER = bytes(ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 256 else c for c in range(256)).translate(bytes(32 if c in b"\t\n\x0b\x0c\r\x85\xa0" else c for c in range(256)))
KIND = bytes(97 if chr(c).isalnum() else 32 if c == 32 else 46 if c in b".," else 112 for c in range(256))
#: Marks that may end a word as a token run of their own; no apostrophe, which the tokenizers' contractions begin with.
TAIL = ".,!?;:#%&*$)|\"…"


class Encoder:
    """Ids of texts by a word-level tokenizer file, with a bounded memory of words already encoded.

    The tokenizers this serves drop white space, never join characters across it, and keep runs of letters and of marks
    apart; a text's ids are those of its words one after the other, and a word's those of its stem and of the marks
    after it. ``tests/llm`` holds this against encoding whole texts. Texts of Latin letters alone are lower-cased and rid of their
    stops and commas as bytes, which makes for fewer different words. Other texts with a separator that Python, but
    not the tokenizer, takes for white space are encoded as a whole. When the memory is full, only the words of the latest batch stay.
    """

    def __init__(self, path: str, end_id: int | None = None, max_words: int = 400_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = max(self.tokenizer.get_vocab().values()) + 1  # ids may have gaps
        self.end = b"" if end_id is None else struct.pack("<I", end_id)
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.max_words = max_words
        self.closes = np.zeros(self.vocabulary, dtype=bool)  # ids that end a run of letters
        for token, at in self.tokenizer.get_vocab().items():
            self.closes[at] = token.endswith("</w>")

    def _each(self, words: list[str]) -> None:
        for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.stems[word] = struct.pack(f"<{len(found.ids)}I", *found.ids)

    def _learn(self, words: list[str]) -> None:
        """Encode words not yet known: runs of letters many at a time, told apart by the ids that close a run."""
        self._each([w for w in words if not w.isalpha()])
        letters = [w for w in words if w.isalpha()]
        groups = [letters[k : k + 200] for k in range(0, len(letters), 200)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            stops = np.flatnonzero(self.closes[ids]) + 1
            if len(stops) != len(group) or stops[-1] != len(ids):
                self._each(group)
                continue
            raw, at = ids.tobytes(), 0
            for word, stop in zip(group, (stops * 4).tolist(), strict=True):
                self.stems[word] = raw[at:stop]
                at = stop

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, the end id last. Null counts as empty."""
        words, whole = [], {}
        for k, text in enumerate(texts):
            if not text:
                words.append([])
                continue
            try:
                raw = text.encode("latin-1").translate(LOWER) if "<|" not in text else None
            except UnicodeEncodeError:
                raw = None
            if raw is not None:
                kinds = raw.translate(KIND)
                if b"p." not in kinds and b".." not in kinds:  # a stop after a letter or digit is a run of its own
                    raw = (raw + b" ").replace(b", ", b" , ").replace(b". ", b" . ")
                words.append(raw.split())
            elif any(c in text for c in "\x1c\x1d\x1e\x1f"):
                words.append([])
                whole[k] = self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                words.append(text.split())
        met = set().union(*words)
        known, stems = self.words, self.stems
        if len(known) > self.max_words:
            self.words = known = {w: known[w] for w in met if w in known}
        if len(stems) > self.max_words:
            stems.clear()
        parts, wanted = [], set()
        for key in met.difference(known):
            word = key.decode("latin-1") if type(key) is bytes else key
            stem, tail = word.rstrip(TAIL), ""
            if len(stem) < len(word):
                if stem and stem[-1].isalpha() and stem[-1] < "\u0130" and "<" not in word:
                    tail = word[len(stem) :]
                else:
                    stem = word
            if stem.isascii() and "<" not in stem:
                stem = stem.lower()
            parts.append((key, stem, tail))
            wanted.add(stem)
            wanted.add(tail)
        wanted.discard("")
        if missing := list(wanted.difference(stems)):
            self._learn(missing)
        for key, stem, tail in parts:
            known[key] = stems[stem] + stems[tail] if tail else stems[stem]
        end = self.end
        out = [b"".join([known[w] for w in ws]) + end for ws in words]
        for k, found in whole.items():
            out[k] = struct.pack(f"<{len(found)}I", *found) + end
        return out


def encoder(path: str, end_id: int | None) -> Encoder:
    """The worker's own encoder for this file; loaded once a process."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def bits_for(vocabulary: int) -> int:
    """Bits that every id below ``vocabulary`` fits in."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Each id in ``bits`` bits, lowest bit first; padded to a whole byte. An id that needs more bits is an error."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} doesn't fit in {bits} bits")
    if bits % 8 == 0:
        return ids.astype("<u2").tobytes() if bits == 16 else ids.view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    flat = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(flat.reshape(-1), bitorder="little").tobytes()


def unpack_bits(raw: bytes | memoryview, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of a block packed by :func:`pack_bits`."""
    if bits == 16:
        return np.frombuffer(raw, "<u2", count).astype("<u4")
    data = np.frombuffer(raw, dtype=np.uint8, count=(count * bits + 7) // 8)
    out = np.zeros((count, 4), dtype=np.uint8)
    if bits % 8 == 0:
        out[:, : bits // 8] = data.reshape(count, bits // 8)
    else:
        flat = np.unpackbits(data, count=count * bits, bitorder="little").reshape(count, bits)
        wide = np.packbits(flat, axis=1, bitorder="little")
        out[:, : wide.shape[1]] = wide
    return out.view("<u4").reshape(-1)


def file_bytes(doc_ids: list[int | None], encoded: list[bytes], bits: int, block: int) -> bytes:
    counts = np.array([len(e) // 4 for e in encoded], dtype="<u8")
    ids = np.frombuffer(b"".join(encoded), dtype="<u4")
    blocks = [pack_bits(ids[k : k + block], bits) for k in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks[:-1]])]).astype("<u8") if blocks else np.zeros(0, "<u8")
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    head = HEAD.pack(MAGIC, bits, block, len(doc_ids), len(ids), len(blocks))
    return b"".join([head, keys.tobytes(), known.tobytes(), counts.tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """A packed file in memory (or memory-mapped): its documents, and any run of ids without reading the rest."""

    def __init__(self, raw: bytes | memoryview):
        magic, self.bits, self.block, self.n_docs, self.n_ids, n_blocks = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        at = HEAD.size
        self.doc_ids = np.frombuffer(raw, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.present = np.frombuffer(raw, np.uint8, self.n_docs, at).astype(bool)
        at += self.n_docs
        self.counts = np.frombuffer(raw, "<u8", self.n_docs, at).astype(np.int64)
        at += 8 * self.n_docs
        self.offsets = np.frombuffer(raw, "<u8", n_blocks, at)
        self.payload = memoryview(raw)[at + 8 * n_blocks :]
        self.starts = np.cumsum(self.counts) - self.counts

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` up to ``stop``; unpacks only the blocks they lie in."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        parts = [unpack_bits(self.payload[int(self.offsets[b]) :], min(self.block, self.n_ids - b * self.block), self.bits) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k] + self.counts[k]))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, end_id: int | None = 2, block: int = 65_536, file_ids: int = 4_000_000) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them to ``path`` in ascending ``doc_id`` order; return the manifest.

    One shuffle by ranges of ``doc_id``; every task writes files of about ``file_ids`` ids (a longer single document
    gets a longer file). A file appears under its name only when complete, and a repeated task writes the same bytes,
    so lost executors do no harm. Manifest: part, seq, file, n_docs, n_tokens. Null texts are empty; null ids sort first;
    rows of equal ``doc_id`` stand in the order of their texts; an empty table gives no file. ``path`` must be in a store that
    both Spark and ``pyarrow.fs`` open (local or shared folders, HDFS, S3, GCS) and where a move replaces a file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        enc = encoder(tokenizer, end_id)
        part, seq, keys, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:05d}.tok"
            draft = f"{root}/_draft-{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(file_bytes(keys, held, bits_for(max(enc.vocabulary, (end_id or 0) + 1)), block))
            store.move(draft, f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "seq": pa.array([seq], pa.int64()), "file": [name], "n_docs": pa.array([len(keys)], pa.int64()), "n_tokens": pa.array([size], pa.int64())})

        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                some = batch.slice(at, 1_024)
                for key, raw in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist()), strict=True):
                    keys.append(key)
                    held.append(raw)
                    size += len(raw) // 4
                    if size >= file_ids:
                        yield flush()
                        seq, keys, held, size = seq + 1, [], [], 0
        if keys:
            yield flush()

    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = ordered.mapInArrow(write, "part long, seq long, file string, n_docs long, n_tokens long")
    manifest.write.mode("overwrite").parquet(f"{path}/_manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{path}/_manifest")


def file_starts(manifest: DataFrame) -> DataFrame:
    """Manifest with ``start``: ids in all files before. Sums run within parts, then over the parts' totals."""
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(over), F.lit(0)))
    own = manifest.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return own.join(totals.select("part", "base"), "part").withColumn("start", F.col("base") + F.col("inner")).drop("base", "inner")


def read_token_files(path: str, manifest: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as u32, little
    endian) and, if ``with_ids``, those ids in that form.

    Files are read as Spark's binary source; a row is one file of bounded size, but for a single longer document.
    """
    spark = manifest.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    starts = file_starts(manifest).select("file", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held = TokenFile(batch.column(0)[k].as_py())
                base = batch.column(1)[k].as_py()
                for at in range(0, held.n_docs, 512):
                    to = min(at + 512, held.n_docs)
                    some = held.ids(int(held.starts[at]), int(held.starts[to - 1] + held.counts[to - 1]))
                    cut = held.starts[at:to] - held.starts[at]
                    raw = [some[s : s + n].data for s, n in zip(cut.tolist(), held.counts[at:to].tolist(), strict=True)]
                    columns = {
                        "doc_id": pa.array(held.doc_ids[at:to], mask=~held.present[at:to]),
                        "start": pa.array(held.starts[at:to] + base, pa.int64()),
                        "n_tokens": pa.array(held.counts[at:to], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([r.tobytes() for r in raw], pa.binary())
                    yield pa.RecordBatch.from_pydict(columns)

    # the starts of a million files are some 100 MB in memory; beyond that the files' rows are shuffled instead
    starts = F.broadcast(starts) if manifest.count() <= BROADCAST_FILES else starts
    return named.join(starts, "file").select("content", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None, *, with_ids: bool = True, **options) -> DataFrame:
    """Write ``docs`` as packed files under ``path`` (a new folder in the shared one by default) and read them back."""
    path = path or f"{shared_dir(docs.sparkSession)}/gristmill-staged/tokens-{uuid.uuid4().hex}"
    return read_token_files(path, write_token_files(docs, path, tokenizer, **options), with_ids=with_ids)

"""Token identifiers in sorted-string-table shards.

One shard is a file of key-ordered blocks. Keys share prefixes with the key before
them, except at restart points; a sparse index holds the last key of every block; a
Bloom filter answers for most absent keys; a footer of fixed length locates both.

    block   entries, restart offsets (u32 each), their number (u32), crc32 (u32)
    entry   varint shared, varint rest, varint value length, rest of key, value
    value   varint ids in the shard before it, identifiers (u16 or u32, little-endian)
    index   entries: varint key length, key, varint offset, varint length
    footer  index offset and length, bloom offset and length, documents, identifiers (u64 each),
            id width, bloom hashes (u32 each), 8 bytes of magic

A key is a null flag, the identifier big-endian with its sign bit turned, and a
number that tells rows of one identifier apart.

Defined results: null or empty texts have the end identifier only; a null doc_id
sorts first; rows that share a doc_id are all kept, ordered by a hash of the text;
an empty table writes no shard and reads back no row. Files are written under a
temporary name and renamed, so a task that runs twice leaves one file.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import uuid
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"LQSSTB01"
FOOTER = struct.Struct("<6Q2I8s")
BLOCK_BYTES = 64 << 10
RESTART = 16
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
#: Bytes of text that go to one shard, about.
SHARD_BYTES = 64 << 20
WORD_ENTRIES = 500_000
PIECE_ENTRIES = 700_000


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def make_key(doc_id: int | None, copy: int) -> bytes:
    head = b"\x00" + bytes(8) if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)
    return head + struct.pack(">I", copy)


def split_key(key: bytes) -> tuple[int | None, int]:
    doc = None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)
    return doc, struct.unpack(">I", key[9:13])[0]


class Bloom:
    def __init__(self, bits: bytearray | bytes, hashes: int = BLOOM_HASHES):
        self.bits, self.hashes = bits, hashes

    @classmethod
    def sized(cls, n: int) -> Bloom:
        return cls(bytearray(max(8, n * BLOOM_BITS_PER_KEY // 8 + 1)))

    def _places(self, key: bytes):
        h = xxhash.xxh3_128_intdigest(key[:9])
        a, b, m = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1, len(self.bits) * 8
        return ((a + k * b) % m for k in range(self.hashes))

    def add(self, key: bytes) -> None:
        for p in self._places(key):
            self.bits[p >> 3] |= 1 << (p & 7)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(key))


class TableWriter:
    """Writes entries that come in key order; holds one block and the index."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = self.docs = self.ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[bytes] = []
        self._reset()

    def _reset(self):
        self.parts, self.size, self.count, self.restarts, self.last = [], 0, 0, [], b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.count % RESTART == 0:
            self.restarts.append(self.size)
        else:
            limit = min(len(key), len(self.last))
            while shared < limit and key[shared] == self.last[shared]:
                shared += 1
        value = varint(self.ids) + ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.parts.append(entry)
        self.size += len(entry)
        self.count += 1
        self.last = key
        self.docs += 1
        self.ids += len(ids)
        self.hashes.append(key[:9])
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self):
        if not self.count:
            return
        body = b"".join(self.parts) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        body += struct.pack("<I", zlib.crc32(body))
        self.out.write(body)
        self.index.append((self.last, self.at, len(body)))
        self.at += len(body)
        self._reset()

    def close(self) -> None:
        self._flush()
        index = b"".join(varint(len(k)) + k + varint(o) + varint(n) for k, o, n in self.index)
        bloom = Bloom.sized(len(self.hashes))
        for key in self.hashes:
            bloom.add(key)
        self.out.write(index + bytes(bloom.bits))
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom.bits), self.docs, self.ids, self.width, BLOOM_HASHES, MAGIC))


class TableReader:
    """Reads one shard from a random-access file."""

    def __init__(self, file, size: int):
        self.file = file
        at, n, b_at, b_n, self.docs, self.ids, self.width, hashes, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        index, self.index, p = self._read(at, n), [], 0
        while p < n:
            k, p = read_varint(index, p)
            key = bytes(index[p : p + k])
            offset, p = read_varint(index, p + k)
            length, p = read_varint(index, p)
            self.index.append((key, offset, length))
        self.bloom = Bloom(self._read(b_at, b_n), hashes)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        _, at, n = self.index[k]
        body = self._read(at, n)
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("a block does not match its checksum")
        count = struct.unpack("<I", body[-8:-4])[0]
        end = len(body) - 8 - 4 * count
        return body[:end], list(struct.unpack(f"<{count}I", body[end : end + 4 * count]))

    def _entries(self, body: bytes, at: int = 0, key: bytes = b""):
        while at < len(body):
            shared, at = read_varint(body, at)
            rest, at = read_varint(body, at)
            n, at = read_varint(body, at)
            key = key[:shared] + body[at : at + rest]
            start, p = read_varint(body, at + rest)
            end = at + rest + n
            yield key, start, np.frombuffer(body, "<u2" if self.width == 2 else "<u4", (end - p) // self.width, p).astype("<u4")
            at = end

    def scan(self):
        """(key, ids in the shard before it, identifiers) of every entry, in order."""
        for k in range(len(self.index)):
            yield from self._entries(self._block(k)[0])

    def lookup(self, doc_id: int | None):
        """Entries of one identifier: Bloom filter, then binary search in index and restart points."""
        low = make_key(doc_id, 0)
        if not self.bloom.may_hold(low):
            return
        k = bisect_left(self.index, low, key=lambda x: x[0])
        while k < len(self.index):
            body, restarts = self._block(k)
            first = lambda r: next(self._entries(body, r))[0]
            r = max(0, bisect_left(restarts, low, key=first) - 1)
            for key, start, ids in self._entries(body, restarts[r]):
                if key[:9] == low[:9]:
                    yield key, start, ids
                elif key > low:
                    return
            k += 1


#: The settings under which words can be encoded one by one (fixed values of the file format):
#: white space parts pieces, and every piece ends with a mark.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
END_OF_WORD = "</w>"


class WordCache:
    """The library's identifiers of every word, kept in a bounded cache.

    White space separates words in tokenizers of the kind above, so a text's identifiers
    are its words' identifiers in order. A word of letters only is one piece of the
    pre-tokenizer, as is a run of full stops and commas after one, so such words are
    looked up as letters and tail, letters of ASCII in lower case. New ones are encoded
    by the library in one call, and the identifiers are told apart by the mark that ends
    every piece, those of other words by the place in the text that they stand for. With
    any other tokenizer, and for texts that hold one of its added tokens, the library
    gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.wordwise = all(spec.get(k) == v for k, v in WORDWISE.items()) and spec["model"].get("end_of_word_suffix") == END_OF_WORD
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.ends = {i for t, i in self.tokenizer.get_vocab().items() if t.endswith(END_OF_WORD)}
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _each(self, words: list[str]) -> list[bytes]:
        """Identifiers of words, by one call: every token goes to the word that it begins in."""
        if not words:
            return []
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begins = np.array([o[0] for o in found.offsets], np.int64)
        ends = np.searchsorted(begins, np.cumsum(sizes))
        return [ids[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Identifiers of words that aren't known yet."""
        pieces = self.pieces
        cores = [w.rstrip(".,") for w in words]
        plain = [len(c) <= 64 and c.isalpha() and (c.isascii() or c.lower().isalpha() and unicodedata.is_normalized("NFC", c)) for c in cores]
        odd = [w for w, p in zip(words, plain) if not p]
        cut = [(w, c.lower() if c.isascii() else c, w[len(c) :]) for w, c, p in zip(words, cores, plain) if p]
        both = {c for _, c, _ in cut} | {t for _, _, t in cut if t}
        new = [p for p in both if p not in pieces]
        if len(pieces) + len(new) > PIECE_ENTRIES:
            held = {p: pieces[p] for p in both if p in pieces}
            pieces.clear()
            pieces.update(held)
        if new:
            order, ids = new, self._library(" ".join(new))
            stops = [k + 1 for k, i in enumerate(ids) if i in self.ends]
            if len(stops) == len(order) and stops[-1] == len(ids):
                raw, begin = struct.pack(f"<{len(ids)}I", *ids), 0
                for p, stop in zip(order, stops):
                    pieces[p] = raw[4 * begin : 4 * stop]
                    begin = stop
            else:  # a letter that the tokenizer's tables class otherwise
                for p in order:
                    ids = self._library(p)
                    pieces[p] = struct.pack(f"<{len(ids)}I", *ids)
        out = dict(zip(odd, self._each(odd)))
        for w, core, tail in cut:
            out[w] = pieces[core] + (pieces[tail] if tail else b"")
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        whole = [k for k, t in enumerate(texts) if t and (not self.wordwise or any(x in t for x in self.added))]
        if whole:
            texts = list(texts)
            apart = {k: np.array(self._library(texts[k]), "<u4").tobytes() for k in whole}
            for k in whole:
                texts[k] = None
            out = self.encode_batch(texts)
            for k, ids in apart.items():
                out[k] = ids
            return out
        split = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        known = self.known
        words = set().union(*split)
        missing = {w for w in words if w not in known}
        fresh = self._learn(list(missing)) if missing else {}
        if len(known) + len(fresh) > WORD_ENTRIES:
            held = {w: known[w] for w in words - missing}
            known.clear()
            known.update(held)
        known.update(fresh)
        out = [b"".join(map(known.__getitem__, ws)) for ws in split]
        for w in [w for w in fresh if len(w) > 64]:  # such words hardly come again
            del known[w]
        return out


_CACHES: dict[str, WordCache] = {}


def _cache(path: str) -> WordCache:
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


def forget() -> None:
    _CACHES.clear()


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def _write_batches(batches, path, folder, end_id, width):
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    words, writer, out = _cache(path), None, None
    name = f"{folder}/shard-{shard:06d}.sst"
    fs, target = _open(name)
    temporary = f"{target}.{uuid.uuid4().hex}.tmp"
    end = np.array([end_id], "<u4").tobytes()
    previous, copy, first = object(), 0, None
    for batch in batches:
        for doc_id, encoded in zip(batch.column("doc_id").to_pylist(), words.encode_batch(batch.column("text").to_pylist())):
            if writer is None:
                fs.create_dir(os.path.dirname(target), recursive=True)
                out = fs.open_output_stream(temporary)
                writer = TableWriter(out, width)
            copy = copy + 1 if doc_id == previous else 0
            previous = doc_id
            key = make_key(doc_id, copy)
            first = first or key
            writer.add(key, np.frombuffer(encoded + end, "<u4"))
    if writer is not None:
        writer.close()
        out.close()
        fs.move(temporary, target)
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int64()), "path": [name], "n_docs": pa.array([writer.docs], pa.int64()), "n_ids": pa.array([writer.ids], pa.int64()), "first_key": [first], "last_key": [key]}
        )


MANIFEST = "shard bigint, path string, n_docs bigint, n_ids bigint, first_key binary, last_key binary"


def write_store(docs: DataFrame, path: str, folder: str, end_id: int = 2) -> DataFrame:
    """Encode documents and write them in ascending doc_id order; returns the manifest with ``base``.

    Rows are dealt by range of (doc_id, hash of the text), so rows that share a doc_id
    need not share a shard; doc_id is a whole number. There are as many shards as SHARD_BYTES
    asks for, and one a task at least. The manifest has a row a shard; its prefix sum is
    taken on the driver.
    """
    spark = docs.sparkSession
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("doc_id must be a whole number")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    words = _cache(path)
    width = 2 if max(words.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
        .repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "_h")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h")
        .select("doc_id", "text")
    )
    written = common.arrow_map(ordered, f"{__name__}:_write_batches", MANIFEST, path=path, folder=folder, end_id=end_id, width=width)
    base, rows = 0, []
    for row in sorted(written.collect(), key=lambda r: r["shard"]):
        rows.append((*row, base))
        base += row["n_ids"]
    return spark.createDataFrame(rows, MANIFEST + ", base bigint")


def _read_batches(batches):
    for batch in batches:
        for uri, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
            fs, target = _open(uri)
            rows: list[tuple] = []
            with fs.open_input_file(target) as f:
                for key, start, ids in TableReader(f, f.size()).scan():
                    rows.append((split_key(key)[0], base + start, ids.tobytes()))
                    if len(rows) >= common.BATCH_ROWS:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)


def _rows(rows):
    ids = [r[2] for r in rows]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(ids, pa.binary())],
        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
    )


def read_store(manifest: DataFrame) -> DataFrame:
    """Every document in the shards: doc_id, start, n_tokens, ids_crc32, ids (unsigned 32-bit, little-endian)."""
    rows = manifest.select("path", "base").repartition(max(1, manifest.count()), "path")
    return common.arrow_map(rows, f"{__name__}:_read_batches", "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


def lookup(spark: SparkSession, manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """Identifiers of one document's rows, read from the shards whose key range holds it."""
    found, low, high = [], make_key(doc_id, 0), make_key(doc_id, (1 << 32) - 1)
    for row in manifest.where((F.col("last_key") >= F.lit(low)) & (F.col("first_key") <= F.lit(high))).orderBy("shard").collect():
        fs, target = _open(row["path"])
        with fs.open_input_file(target) as f:
            found += [ids for _, _, ids in TableReader(f, f.size()).lookup(doc_id)]
    return found

"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order:

    block*   zstd of entries: shared u8, own u8, width u8, count u32, key suffix, ids
    index    zstd of (last key, offset, size, entries, tokens) of every block
    bloom    bits over the keys
    footer   fixed size: offsets and sizes of both, hash count, documents, tokens,
             first and last key, CRC of index and bloom, magic

Keys are prefix-compressed against the entry before them in their block: a byte for
null or not, then the id as a big-endian integer with its sign bit turned, so byte
order is id order.  A lookup asks the Bloom filter, binary-searches the sparse index
and scans one block.

Writing is one range partition of documents per task: the task sorts, encodes and
writes shards of ``SHARD_BYTES``; a shard is written under a name of the attempt and
then renamed, so a repeated task replaces equal content.  Reading back goes through
Spark's ``binaryFile`` source.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkstream.llm import _text
from inkstream.llm._stash import Stash

END_ID = 1
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 8 << 20
BLOOM_BITS = 10
BLOOM_HASHES = 7
CACHED_WORDS = 250_000
#: Bytes of text encoded at once.
ENCODE_BYTES = (2 << 20) - 64
#: Bytes of input files for each range of ids.
RANGE_BYTES = 64 << 20
#: Ranges whose shards are summed together.
BLOCK_RANGES = 1024
MAGIC = b"inkSST01"
_FOOTER = struct.Struct("<QQQQIQQ9s9sI8s")
_INDEX = struct.Struct("<9sQIIQ")
_HEAD = struct.Struct("<BBBI")
_NULL_KEY = b"\0" * 9


def key_of(doc_id: int | None) -> bytes:
    return _NULL_KEY if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _bloom_places(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    a = np.array([zlib.crc32(k) << 32 | zlib.adler32(k) for k in keys], dtype=np.uint64)
    a = _text.mix(a + np.array([struct.unpack(">Q", k[1:])[0] for k in keys], dtype=np.uint64))
    b = _text.mix(a) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


class ShardWriter:
    """Builds one shard in memory; keys must come in ascending order."""

    def __init__(self, block_bytes: int = BLOCK_BYTES):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.block_bytes = block_bytes
        self.out, self.index, self.keys = bytearray(), bytearray(), []
        self.block, self.held, self.tokens, self.block_tokens, self.last = bytearray(), 0, 0, 0, b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys out of order")
        shared = len(os.path.commonprefix([self.last, key])) if self.held else 0
        width = 2 if not len(ids) or int(ids.max()) < 65536 else 4
        self.block += _HEAD.pack(shared, len(key) - shared, width, len(ids)) + key[shared:] + ids.astype(f"<u{width}").tobytes()
        self.keys.append(key)
        self.last = key
        self.held += 1
        self.block_tokens += len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            packed = self.pack(bytes(self.block))
            self.index += _INDEX.pack(self.last, len(self.out), len(packed), self.held, self.block_tokens)
            self.out += packed
            self.tokens += self.block_tokens
            self.block, self.held, self.block_tokens = bytearray(), 0, 0

    @property
    def size(self) -> int:
        return len(self.out) + len(self.block)

    def finish(self) -> bytes:
        self._flush()
        index = self.pack(bytes(self.index))
        bits = max(64, len(self.keys) * BLOOM_BITS)
        flags = np.zeros(bits, bool)
        flags[_bloom_places(self.keys, bits, BLOOM_HASHES).reshape(-1)] = True
        bloom = struct.pack("<Q", bits) + np.packbits(flags, bitorder="little").tobytes()
        at = len(self.out)
        foot = _FOOTER.pack(
            at, len(index), at + len(index), len(bloom), BLOOM_HASHES, len(self.keys), self.tokens, self.keys[0], self.keys[-1], zlib.crc32(index + bloom), MAGIC
        )
        return bytes(self.out) + index + bloom + foot


class Shard:
    """Reads one shard from its bytes."""

    def __init__(self, data: bytes):
        import zstandard

        self.data = memoryview(data)
        self.unpack = zstandard.ZstdDecompressor().decompress
        (i, n, b, m, self.hashes, self.documents, self.tokens, self.first, self.last, crc, magic) = _FOOTER.unpack(self.data[-_FOOTER.size :])
        if magic != MAGIC or zlib.crc32(self.data[i : b + m]) != crc:
            raise ValueError("not a whole shard")
        self.index = [_INDEX.unpack_from(raw, k) for raw in [self.unpack(bytes(self.data[i : i + n]))] for k in range(0, len(raw), _INDEX.size)]
        self.bits = struct.unpack_from("<Q", self.data, b)[0]
        self.bloom = self.data[b + 8 : b + m]

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size, _, _ = self.index[k]
        raw, key, pos = self.unpack(bytes(self.data[at : at + size])), b"", 0
        while pos < len(raw):
            shared, own, width, count = _HEAD.unpack_from(raw, pos)
            pos += _HEAD.size
            key = key[:shared] + raw[pos : pos + own]
            pos += own
            yield key, np.frombuffer(raw, f"<u{width}", count, pos).astype("<u4")
            pos += width * count

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self._block(k)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places([key], self.bits, self.hashes)[0].tolist())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every entry under ``doc_id``; empty if there is none."""
        key, out = key_of(doc_id), []
        if not self.first <= key <= self.last or not self.may_hold(key):
            return out
        low, high = 0, len(self.index) - 1
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        for k in range(low, len(self.index)):
            for at, ids in self._block(k):
                if at > key:
                    return out
                if at == key:
                    out.append(ids)
        return out


_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: ASCII punctuation that stands alone beside a letter; "'" starts contractions and "<" special tokens.
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "'<"]] = True
_WHOLE = np.zeros(256, bool)
_WHOLE[[0x27, 0x3C]] = True


class WordEncoder:
    """Encodes texts part by part with a two-generation cache of parts.

    The tokenizer splits at white space and drops it, so a text's ids are its words'
    ids in order.  If it also splits letters from punctuation or folds A-Z, as asked of
    it here, so does the cache; words with an apostrophe or "<" stay whole.  Equal parts
    of a chunk are encoded once.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.cached, self.young, self.old = cached, {}, {}
        pre, ids = self.tokenizer.pre_tokenizer, lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        marks = [chr(c) for c in np.flatnonzero(_MARK)]
        self.splits = pre is not None and all([p for p, _ in pre.pre_tokenize_str(t)] == [p for q in (t[:2], t[2:3], t[3:]) for p, _ in pre.pre_tokenize_str(q)] for t in (f"ab{m}cd" for m in marks))
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        self.folds = ids(upper) == ids(upper.lower()) and all(ids(c) == ids(c.lower()) for c in upper)

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        young, old = self.young, self.old
        out = [young.get(w) for w in parts]
        missing = []
        for i in [i for i, v in enumerate(out) if v is None]:
            got = old.get(parts[i])
            if got is None:
                missing.append(i)
            else:
                out[i] = young[parts[i]] = got
        if missing:
            encoded = self.tokenizer.encode_batch_fast([parts[i].decode() for i in missing], add_special_tokens=False)
            lists = [e.ids for e in encoded]
            ends = np.cumsum([len(x) for x in lists]) * 4
            raw = np.fromiter((i for x in lists for i in x), "<u4", int(ends[-1]) // 4).tobytes()
            for i, a, b in zip(missing, [0, *ends[:-1].tolist()], ends.tolist()):
                out[i] = young[parts[i]] = raw[a:b]
        if len(young) > self.cached:
            self.old, self.young = young, {}
        return out

    def _parts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.splits or len(data) < 2:
            return starts, ends
        letter, mark = _LETTER[data], _MARK[data]
        cut = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1
        whole = np.concatenate([np.zeros(1, np.int32), np.cumsum(_WHOLE[data], dtype=np.int32)])
        word = np.searchsorted(starts, cut, "right") - 1
        ok = (cut > starts[word]) & (cut < ends[word]) & (whole[ends[word]] == whole[starts[word]])
        cut = cut[ok]
        return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))

    @staticmethod
    def _folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The bytes with A-Z in lower case, but for words with "<": special tokens are matched as written."""
        low, less = _text._LOWER[data], data == 0x3C
        if not less.any():
            return low
        opens = np.concatenate([np.zeros(1, np.int32), np.cumsum(less, dtype=np.int32)])
        special = opens[ends] > opens[starts]
        if special.any():
            edge = np.zeros(len(data) + 1, np.int8)
            edge[starts[special]] += 1
            edge[ends[special]] -= 1
            inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
            low[inside] = data[inside]
        return low

    def encode(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        starts, ends, _ = _text.word_bounds(data, offs)
        if not len(starts):
            return [np.zeros(0, "<u4")] * (len(offs) - 1)
        if self.folds:
            data = self._folded(data, starts, ends)
        starts, ends = self._parts(data, starts, ends)
        _, which, back = np.unique(_text.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        coded = self._ids([raw[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist())])
        sizes = np.array([len(c) for c in coded]) // 4
        flat, begin = np.frombuffer(b"".join(coded), "<u4"), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        each = sizes[back]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(begin[back] - upto[:-1], each) + np.arange(upto[-1])]
        bounds = upto[np.searchsorted(starts, offs)]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


#: A worker process keeps its encoders, and so its words, from task to task.
_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _write_shards(root: str, tokenizer: str, shard_bytes: int):
    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, folder = fs.FileSystem.from_uri(root)
        encoder = _encoder(tokenizer)
        writer, n = ShardWriter(), 0

        def close():
            nonlocal writer, n
            name = f"{folder}/part-{task.partitionId():07d}-{n:05d}.sst"
            trial = f"{folder}/.{os.path.basename(name)}.{task.taskAttemptId()}"
            with store.open_output_stream(trial) as out:
                out.write(writer.finish())
            store.move(trial, name)
            row = pa.RecordBatch.from_pydict({"shard": [os.path.basename(name)], "documents": [len(writer.keys)], "tokens": [writer.tokens]})
            writer, n = ShardWriter(), n + 1
            return row

        for batch, data, offs in _text.chunks(batches, limit=ENCODE_BYTES):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(data, offs)):
                writer.add(key_of(doc_id), np.append(ids, np.uint32(END_ID)))
                if writer.size >= shard_bytes:
                    yield close()
        if writer.keys:
            yield close()

    return run


def _read_shards(batches):
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            ids, starts, sizes, sums, at = [], [], [], [], 0
            for key, tokens in Shard(content.as_buffer()):
                ids.append(id_of(key))
                starts.append(at)
                sizes.append(len(tokens))
                sums.append(zlib.crc32(tokens.tobytes()))
                at += len(tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path.as_py().rsplit("/", 1)[-1]] * len(ids)), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def _read_bytes(docs: DataFrame) -> int:
    """Bytes of the files under a plan, as its leaves state them; 0 for leaves that are not files."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def starts_of(shards: DataFrame) -> DataFrame:
    """(shard, base): the ids in all shards before one; names are in key order.

    Running sums within blocks of ranges, then over the blocks' totals, of which there is
    one for ``BLOCK_RANGES`` ranges.
    """
    s = shards.select("shard", "tokens", F.floor(F.regexp_extract("shard", r"^part-(\d+)-", 1).cast("long") / BLOCK_RANGES).alias("block"))
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = s.groupBy("block").agg(F.sum("tokens").alias("tokens")).select("block", before(Window.orderBy("block")).alias("start"))
    inside = s.select("shard", "block", before(Window.partitionBy("block").orderBy("shard")).alias("inside"))
    return inside.join(blocks, "block").select("shard", (F.col("start") + F.col("inside")).alias("base"))


def write(docs: DataFrame, tokenizer: str, root: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write shards of ``docs`` (doc_id, text) under ``root``, a URI that executors reach; one row a shard.

    The rows are lazy: an action on them writes.  Null texts are written as empty, null
    ids first under a key of their own, repeated ids one after the other by text.
    There is a range of ids for every ``RANGE_BYTES`` that ``docs`` reads, and at least
    the session's number of shuffle partitions.
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-_read_bytes(docs) // RANGE_BYTES))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(_write_shards(root, tokenizer, shard_bytes), "shard string, documents long, tokens long")


def read(spark, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every entry of the shards under ``root``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.sst").load(root)
    return files.select("path", "content").mapInArrow(_read_shards, "shard string, doc_id long, at long, n_tokens long, ids_crc32 long")


def tokenize(docs: DataFrame, tokenizer: str | None = None, root: str | None = None) -> DataFrame:
    """Encode ``docs`` into shards, read them back: (doc_id, start, n_tokens, ids_crc32, shard).

    ``start`` counts the ids of all documents before one in ascending id order; ids end
    with id 1; the checksum is over little-endian unsigned 32-bit ids.  Extra columns are
    ignored; an empty table gives no shards and an empty result.
    """
    spark = docs.sparkSession
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    stash = Stash(spark, "tokens")
    root = root or stash.folder("shards")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    shards = stash.put(write(docs, tokenizer, root), "manifest")
    stash.release()
    entries = read(spark, root)
    return entries.join(starts_of(shards), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")

"""Token-id output with a minimal perfect hash index.

``write_tokens`` encodes whole texts with the ``tokenizers`` library, appends an end id to each document, and writes raw little-endian ids into shards
in ascending doc_id order: ``shard-NNNNNN.bin`` holds nothing but ids (16 bits each where the vocabulary
fits, else 32).  A document's place is its ``start``, the number of ids of all documents before it.

The index maps a document key to its place.  Keys are dealt to buckets by hash; each bucket's file holds a minimal perfect
hash (levels of bitmaps: a key settles in the first level where no other key shares its bit; its slot is the rank of
that bit), and for each slot a 32-bit fingerprint of the key, the start, the number of ids and the number of documents.  A lookup reads the file of one bucket, of about
``KEYS_A_BUCKET`` keys whatever the number of documents, and a few words of it; a key that was never stored is rejected by its fingerprint (one in 2^32 is not).

Defined cases: null or empty text is just the end id; rows without a doc_id come first in the shards and have no key;
rows that repeat a doc_id are ordered by hash of the text and then text, their ids are adjacent, and the key leads to all of them;
a very long text is encoded whole; an empty table gives shards and an index without entries.  Only doc_id and text are read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyscope.llm.common import fresh_dir, map_arrow, materialize, text_of
from supplyscope.llm.files import open_fs, replaced_file

MAX_CACHED = 800_000  # words whose ids a task remembers; others are encoded again each time
INDEX_MAGIC = b"MPHX0001"
KEYS_A_BUCKET = 1 << 17
LEVEL_SLACK = 1.6  # bits a key in each level's bitmap


# ---- encoding ----------------------------------------------------------------------------------------------------

class _WordIds(dict):
    """Packed ids by word, filled as words are met.  ``lead`` is what stands before each word: a space or nothing."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, word: str) -> bytes:
        ids = self.encoder.word(self.lead, word)
        if len(self) < MAX_CACHED and len(word) <= 40:
            self[word] = ids
        return ids


class Encoder:
    """Encodes texts with a tokenizer file, ids packed as little-endian bytes.

    A byte-level tokenizer without normalizer cuts a text before every single space or line feed that stands between other characters,
    so words between them are encoded one by one and remembered.  Any other text or tokenizer is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        kind = type(self.tokenizer.pre_tokenizer).__name__
        self.by_word = kind == "ByteLevel" and not self.tokenizer.pre_tokenizer.add_prefix_space and self.tokenizer.normalizer is None
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word &= not any(re.search(r"\s", t) for t in added)
        shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.after_space, self.at_start = _WordIds(self, " "), _WordIds(self, "")
        self.model = self.tokenizer.model
        self.line_feed = self.whole("\n")
        self.plain_end = {c: self.whole(c) for c in ".,;:!?"}  # after letters, a piece of its own

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)

    def word(self, lead: str, word: str) -> bytes:
        if word.isalpha() and max(word) < "ɐ":  # Latin letters: one piece for the library's model
            piece = (lead + word).encode().decode("latin-1").translate(self.letters)
            return self.packed([t.id for t in self.model.tokenize(piece)])
        body = word[:-1]
        if body.isalpha() and word[-1] in self.plain_end and max(body) < "ɐ":
            return (self.after_space if lead else self.at_start)[body] + self.plain_end[word[-1]]
        return self.whole(lead + word)

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self.whole(text)
        if re.search(r"\s\s", text):
            first, *rest = re.split(r"(?<=\S) (?=\S)", text)
            return self.at_start[first] + b"".join(map(self.after_space.__getitem__, rest))
        after, start = self.after_space.__getitem__, self.at_start
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(start[first] + b"".join(map(after, rest)))
        return self.line_feed.join(lines)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---- minimal perfect hash ----------------------------------------------------------------------------------------

def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys (the splitmix64 finalizer)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


@dataclass
class PerfectHash:
    """Bitmaps of the levels, one after another (64 bits a word), with the number of set bits before each word."""

    level_bits: np.ndarray  # the size of each level, a multiple of 64
    words: np.ndarray
    ranks: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys`` are distinct 64-bit integers."""
        sizes, maps, left, level = [], [], keys.astype(np.uint64), 0
        while len(left):
            bits = max(64, -(-int(len(left) * LEVEL_SLACK) // 64) * 64)
            at = mix(left, level) % np.uint64(bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            sizes.append(bits)
            maps.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at.astype(np.int64)]]
            level += 1
        words = np.concatenate(maps).view("<u8") if maps else np.zeros(0, "<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        return cls(np.array(sizes, "<i8"), words, (np.cumsum(counts) - counts).astype("<i8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, from 0 to the number of keys less one; -1 for some of the keys that were not built in."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left, before = np.arange(len(keys)), 0
        keys = keys.astype(np.uint64)
        for level, bits in enumerate(self.level_bits.tolist()):
            if not len(left):
                break
            at = (mix(keys[left], level) % np.uint64(bits)).astype(np.int64) + before
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[at[hit] >> 6] + np.bitwise_count(below).astype(np.int64)
            left, before = left[~hit], before + bits
        return out


def pack_index(keys: np.ndarray, values: list[np.ndarray]) -> bytes:
    """The file of one bucket: header, levels, bitmaps, ranks, and by slot the fingerprint and the values (64 bits each)."""
    table = PerfectHash.build(keys)
    order = np.empty(len(keys), dtype=np.int64)
    order[table.slots(keys)] = np.arange(len(keys))
    head = INDEX_MAGIC + struct.pack("<4q", len(keys), len(table.level_bits), len(table.words), len(values))
    marks = fingerprint(keys)[order]
    pad = b"\0" * (-marks.nbytes % 8)
    return b"".join([head, table.level_bits.tobytes(), table.words.tobytes(), table.ranks.tobytes(), marks.tobytes(), pad,
                     *(v.astype("<i8")[order].tobytes() for v in values)])


class BucketIndex:
    """A bucket's file, read for lookups."""

    def __init__(self, data: bytes):
        if data[:8] != INDEX_MAGIC:
            raise ValueError("not an index file")
        n, levels, words, values = struct.unpack_from("<4q", data, 8)
        at = 40

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += -(-out.nbytes // 8) * 8
            return out

        self.table = PerfectHash(take(levels, "<i8"), take(words, "<u8"), take(words, "<i8"))
        self.marks = take(n, "<u4")
        self.values = [take(n, "<i8") for _ in range(values)]

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(whether each key is stored, its values)."""
        slots = self.table.slots(keys)
        found = slots >= 0
        found[found] = self.marks[slots[found]] == fingerprint(keys[found])
        return found, [np.where(found, v[np.where(found, slots, 0)] if len(v) else 0, 0) for v in self.values]


# ---- tables and files --------------------------------------------------------------------------------------------

@dataclass
class TokenStore:
    """What ``write_tokens`` made.  ``directory`` has (shard, doc_id, start, n_tokens), one row a document."""

    uri: str
    bits: int
    shard_starts: list[int]  # ids before each shard
    buckets: int
    directory: DataFrame

    def lookup(self, keys: DataFrame, key: str = "doc_id") -> DataFrame:
        """Rows (doc_id, start, n_tokens, n_docs, shard of the start) for those of the keys that the index holds."""
        uri, buckets, starts = self.uri, self.buckets, np.array(self.shard_starts)
        dealt = (keys.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"))
                 .withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
                 .repartition(buckets, "bucket").sortWithinPartitions("bucket"))
        held: OrderedDict[int, BucketIndex] = OrderedDict()

        def index(bucket: int) -> BucketIndex:
            if bucket not in held:
                fs, path = open_fs(f"{uri}/index-{bucket:06d}.mph")
                while len(held) > 3:
                    held.popitem(last=False)
                held[bucket] = BucketIndex(fs.open_input_stream(path).read())
            return held[bucket]

        def run(batch: pa.RecordBatch):
            ids, where = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for b in np.unique(where).tolist():
                own = ids[where == b]
                found, values = index(b).get(own)
                shard = np.searchsorted(starts, values[0], side="right") - 1  # the last of those that start there: empty ones come before
                yield pa.RecordBatch.from_arrays([pa.array(x[found], pa.int64()) for x in (own, *values, shard)],
                                                 names=["doc_id", "start", "n_tokens", "n_docs", "shard"])

        return map_arrow(dealt, "doc_id long, start long, n_tokens long, n_docs long, shard long", run)

    def read(self, places: DataFrame, with_ids: bool = False) -> DataFrame:
        """Rows (doc_id, start, n_tokens, ids_crc32[, ids]) for rows (shard, doc_id, start, n_tokens), read from the shards."""
        uri, bits, starts = self.uri, self.bits, np.array(self.shard_starts)
        placed = places.select("doc_id", "start", "n_tokens", "shard")
        placed = placed.repartition(len(self.shard_starts), "shard").sortWithinPartitions("shard", "start")
        kind, width = np.dtype("<u2" if bits == 16 else "<u4"), bits // 8
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

        def run(batch: pa.RecordBatch):
            crcs, lists, files = [], [], {}
            for start, n, shard in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if shard not in files:
                    fs, path = open_fs(f"{uri}/shard-{shard:06d}.bin")
                    files = {shard: fs.open_input_file(path)}
                data = files[shard].read_at(n * width, (start - int(starts[shard])) * width)
                ids = np.frombuffer(data, dtype=kind)
                if len(ids) != n:
                    raise ValueError(f"shard {shard} ends before id {start + n}")
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                if with_ids:
                    lists.append(ids.astype(np.int32))
            cols = [batch.column(0), batch.column(1), batch.column(2), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(lists, pa.list_(pa.int32()))] * with_ids, names=names)

        return map_arrow(placed, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids, run)

    def read_all(self, keys: DataFrame, with_ids: bool = False) -> DataFrame:
        """One row for each stored document that one of ``keys`` (column doc_id) leads to, and for each without a key if keys hold a null.

        Places come from the index; where a key leads to several documents, the directory tells them apart.
        """
        ids = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        found = materialize(self.lookup(ids), "places")
        several = found.where("n_docs > 1").select(F.col("doc_id").alias("k"))
        rows = self.directory.select("doc_id", "start", "n_tokens", F.col("shard").cast("long").alias("shard"))
        nulls = ids.where("doc_id IS NULL").select(F.col("doc_id").alias("k")).limit(1)
        places = (found.where("n_docs = 1").select("doc_id", "start", "n_tokens", "shard")
                  .unionByName(rows.join(several, F.col("doc_id") == F.col("k"), "left_semi"))
                  .unionByName(rows.where("doc_id IS NULL").join(nulls, F.col("doc_id").eqNullSafe(F.col("k")), "left_semi")))
        return self.read(places, with_ids)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, shards: int | None = None, uri: str | None = None) -> TokenStore:
    """Encode ``docs`` (doc_id, text) into shards and build the index; ``tokenizer`` is a tokenizers JSON file on every machine.

    The rows are dealt to shards by range of (doc_id, hash of the text), so a doc_id that many rows repeat is spread too.
    """
    spark: SparkSession = docs.sparkSession
    uri = uri or fresh_dir(spark, "tokens")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t")).withColumn("h", F.xxhash64("t"))
    dealt = rows.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "t").select("doc_id", "t")

    def run(batches):
        shard, written = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        with replaced_file(f"{uri}/shard-{shard:06d}.bin") as out:
            for batch in batches:
                counts = []
                for value in batch.column(1):
                    data = enc.encode(value.as_py()) + end
                    out.write(data)
                    counts.append(len(data) // enc.dtype.itemsize)
                n = np.array(counts, dtype=np.int64)
                at = written + np.cumsum(n) - n
                written += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard), pa.int32()), batch.column(0), pa.array(at), pa.array(n)],
                                                 names=["shard", "doc_id", "at", "n_tokens"])

    placed = materialize(dealt.mapInArrow(run, "shard int, doc_id long, at long, n_tokens long"), "directory")
    totals = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a shard
    count = max(totals, default=-1) + 1
    starts = [0]
    for s in range(count):
        starts.append(starts[-1] + totals.get(s, 0))
    bases = spark.createDataFrame([(s, starts[s]) for s in range(count)], "shard int, base long")
    directory = placed.join(bases, "shard").select("shard", "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens")
    keyed = directory.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    buckets = max(1, -(-placed.count() // KEYS_A_BUCKET))

    def build(batch):
        bucket = int(batch.column("bucket")[0].as_py())
        ids, start, n, n_docs = (batch.column(c).to_numpy() for c in ("doc_id", "start", "n_tokens", "n_docs"))
        with replaced_file(f"{uri}/index-{bucket:06d}.mph") as out:
            out.write(pack_index(ids, [start, n, n_docs]))
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "n_keys": pa.array([len(ids)], pa.int64())})

    built = (keyed.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).groupBy("bucket")
             .applyInArrow(build, "bucket long, n_keys long").collect())  # one row a bucket
    for b in set(range(buckets)) - {r["bucket"] for r in built}:
        with replaced_file(f"{uri}/index-{b:06d}.mph") as out:
            out.write(pack_index(np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 3))
    bits = 8 * encoder(tokenizer).dtype.itemsize
    return TokenStore(uri, bits, starts[:-1] or [0], buckets, directory)

"""SimHash near-dedup by pigeonhole blocks.

``fingerprints`` gives each document a 64-bit SimHash of its word shingles, ``link_fingerprints``
finds every pair of distinct fingerprints within ``max_bits``, and ``simhash_components`` joins the
components back to the documents.

A fingerprint is cut into ``blocks`` blocks.  Two fingerprints that differ in at most ``max_bits`` bits agree on
at least ``blocks - max_bits`` blocks, so they meet under one of the C(blocks, max_bits) keys made of that
many blocks; there the Hamming distance is verified.  Buckets of up to ``bucket_pairs`` fingerprints are
compared pair by pair.  A larger bucket is not: its fingerprints go to an exact second way, in which
each emits the centres at distance up to 1 and up to ``max_bits - 1``.  Two
fingerprints within ``max_bits`` bits have a centre in reach 1 of one and ``max_bits - 1`` of the other, and all that
reach a centre link to its smallest near member, so links grow with the fingerprints and not with their square.

Defined cases: null or empty text (or one without words) has fingerprint zero and links like any other;
fewer words than a shingle make one shingle of the whole sequence; repeated rows and repeated doc_ids
keep their own rows and share a component if their fingerprints do; a component of rows whose
doc_ids are all null has component_id null; an empty table gives no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyscope.llm.common import map_arrow, materialize, text_of
from supplyscope.llm.components import components

CHUNK = 1 << 16  # shingles whose bits are counted at a time


def simhash(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    words = text.lower().split()  # of bytes: A-Z only, and the ASCII space characters only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, 42) for g in grams], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i:i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Rows (doc_id, fp) for every row of ``docs``; fp is the SimHash as a signed long."""

    def run(batch: pa.RecordBatch):
        fps = [simhash(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_of()), "doc_id long, fp long", run)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """One 64-bit mask for each choice of ``blocks - max_bits`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [_signed(sum(c)) for c in combinations(block, blocks - max_bits)]


def ball_masks(radius: int) -> list[int]:
    """All 64-bit masks of at most ``radius`` set bits."""
    return [_signed(sum(1 << b for b in c)) for r in range(radius + 1) for c in combinations(range(64), r)]


def _near(a: Column, b: Column, max_bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= max_bits


def _centres(fps: DataFrame, radius: int) -> DataFrame:
    """Rows (centre, fp): every centre within ``radius`` bits of each fingerprint."""
    masks = F.array(*[F.lit(m).cast("long") for m in ball_masks(1)])
    out = fps.select("fp", F.lit(64).alias("free"), F.col("fp").alias("centre"))
    for _ in range(radius):  # bits are flipped in falling order, so each centre appears once
        out = out.select("fp", F.explode(F.concat(
            F.array(F.struct(F.lit(0).alias("free"), F.col("centre"))),
            F.transform(F.slice(masks, 2, F.col("free")), lambda m, i: F.struct(
                i.alias("free"), F.col("centre").bitwiseXOR(m).alias("centre"))))).alias("c")).select("fp", "c.free", "c.centre")
    return out.select("centre", "fp")


def ball_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``max_bits``, through shared centres."""
    anchor = _centres(fps, 1).groupBy("centre").agg(F.min("fp").alias("a"))
    return (_centres(fps, max_bits - 1).join(anchor, "centre").where(F.col("a") != F.col("fp"))
            .select("a", F.col("fp").alias("b")).distinct())


def link_fingerprints(fps: DataFrame, max_bits: int = 3, blocks: int = 6, bucket_pairs: int = 128) -> DataFrame:
    """Links (a, b) between distinct fingerprints of the column ``fp``.

    Every pair within ``max_bits`` (1 or more) bits is linked, directly in buckets of up to ``bucket_pairs``
    members and through a common neighbour within ``max_bits`` bits in larger ones.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(blocks, max_bits)])
    keys = fps.select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("t", "k"))
    size = keys.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    size = materialize(size, "buckets", narrow=True)
    twos = size.where((F.col("n") == 2) & _near(F.col("lo"), F.col("hi"), max_bits)).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    members = keys.join(size.where("n > 2").select("t", "k", "n"), ["t", "k"]).select("t", "k", "n", "fp")
    members = materialize(members, "members", narrow=True)
    some = (members.where(F.col("n") <= bucket_pairs).groupBy("t", "k").agg(F.sort_array(F.collect_list("fp")).alias("m"))
            .select("m", F.explode("m").alias("a"))
            .select("a", F.explode(F.filter("m", lambda b: (b > F.col("a")) & _near(F.col("a"), b, max_bits))).alias("b")))
    out = twos.unionByName(some)
    hot = members.where(F.col("n") > bucket_pairs).select("fp").distinct()
    if not hot.isEmpty():
        out = out.unionByName(ball_links(hot, max_bits))
    return out.distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 3, blocks: int = 6, bucket_pairs: int = 128) -> DataFrame:
    """Rows (doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id among the documents whose fingerprints are connected by
    steps of at most ``max_bits`` differing bits.
    """
    prints = materialize(fingerprints(docs, shingle), "simhash", narrow=True)
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(link_fingerprints(own.select("fp"), max_bits, blocks, bucket_pairs)).withColumnRenamed("node", "fp")
    named = own.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` less the near-duplicates: of each component the row with the smallest doc_id stays.

    Rows that share that doc_id are repeats too: one of them stays.  Rows without a doc_id are kept,
    since they have no name to be dropped by.
    """
    named = docs.where("doc_id IS NOT NULL")
    classes = materialize(simhash_components(named.select("doc_id", "text"), **options), "classes", narrow=True)
    keep = classes.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    ids = lambda cond: keep.where(cond).select(F.col("doc_id").alias("keep_id"))

    def pick(cond: str) -> DataFrame:
        own = ids(cond)
        return named.join(own, named["doc_id"].cast("long") == own["keep_id"], "left_semi")

    out = pick("n = 1").unionByName(docs.where("doc_id IS NULL"))
    if not ids("n > 1").isEmpty():
        out = out.unionByName(pick("n > 1").dropDuplicates(["doc_id"]))
    return out

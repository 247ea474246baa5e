"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all documents give inverse document frequencies.
2. A randomised SVD (Halko, Martinsson and Tropp, 2011) of TF-IDF passages gives a latent basis.  Its rows are the passages of the benchmark
   and all passages of all documents; tasks multiply their rows with the current basis, and their sums are added by word.
3. Every passage of every document (windows of ``WINDOW`` words, half overlapping) is projected on the basis and compared with every benchmark passage: the cosine
   of their projections, so that a copy scores 1 whatever share of it the basis keeps.  Passages from ``least_cosine`` on are candidates.
4. A candidate is confirmed by the longest common subsequence of the item's words and the words around the passage, which must cover
   ``least_cover`` of the item, and by its answer (the column ``answer`` if the benchmark has one, else the last ``ANSWER_WORDS`` words): the same share of its words must occur
   there in order too.  So dropped, added or exchanged words and changed punctuation do not hide an item.

The benchmark is a stated set of queries held against all documents in blocks of ``items_a_pass`` items.

Defined cases: null or empty texts, and texts without words, match nothing; items without words are never found; a
very long text is compared in all its windows; repeated rows are judged each; repeated or null item_ids are found like others
and listed once; an empty benchmark or empty documents give no rows found.  Only doc_id and text are read, and item_id, text and answer of the benchmark.
"""

from __future__ import annotations

import io
import math
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.llm.common import fresh_dir, map_arrow, materialize, text_of
from supplyscope.llm.files import open_fs, replaced_file

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
BLOCK = 1 << 10
WINDOW = 32  # words in a passage; half of them is the step
RANK, OVERSAMPLE, POWER_STEPS = 96, 16, 0
FAN_IN = 64  # partial sums that one group adds up
WORDS_A_TASK = 1 << 24  # a task adds up its sums for all its words, so that few of them are shuffled
TOGETHER = 64  # half windows multiplied at once; the result is the same
LEAST_COSINE, LEAST_COVER, ANSWER_WORDS = 0.20, 0.7, 6
ITEMS_A_PASS = 4096
# Work alone depends on these, not the result: how many pairs of a text's window and a passage are filtered together, by how many words an item, in a table of how many bytes at most.
SOME_PAIRS, WANTED, NEAR_BYTES = 32, 128, 1 << 26

#: ASCII other than letters, digits and underscore ends a word, and so does the punctuation of ``_ODD``.
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
_ODD = re.compile("[\u00a0-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb\u00bf\u2000-\u206f\u3000-\u3003\u3008-\u3011]")


def words_of(text: str | None) -> list[bytes]:
    """The words of a lower-cased text, in UTF-8."""
    if not text:
        return []
    if not text.isascii() and _ODD.search(text):
        text = _ODD.sub(" ", text)
    return text.lower().encode("utf-8", "replace").translate(_SPACED).split()


def buckets_of(words: list[bytes]) -> np.ndarray:
    """The hash bucket of each word."""
    h = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)


def window_starts(n: int) -> np.ndarray:
    """The first word of each passage of a text of n words; the last passage reaches the end."""
    return np.arange(0, max(1, -(-n // (WINDOW // 2)) - 1)) * (WINDOW // 2)


def bucketed(texts: DataFrame) -> DataFrame:
    """Rows (buckets), the buckets of the words of each text (column 0) as 16-bit numbers."""

    def run(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([pa.array([buckets_of(words_of(t)).astype("<u2").tobytes() for t in batch.column(0).to_pylist()], pa.binary())], names=["buckets"])

    return map_arrow(texts, "buckets binary", run)


def bucketed_documents(docs: DataFrame, items: list[tuple] | None, least_cover: float) -> DataFrame:
    """Rows (doc_id, text_hash, text, buckets) of rows (doc_id, text, text_hash).  The text is null where none of ``items`` can be covered; without items it always stays."""
    queries = Queries.make(items, np.zeros((BUCKETS, 1), np.float32), np.zeros(BUCKETS)) if items is not None else None

    def run(batch: pa.RecordBatch):
        found = [buckets_of(words_of(t)) for t in batch.column(1).to_pylist()]
        can = pa.array([queries is None or queries.can_cover_any(b, least_cover) for b in found], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pc.if_else(can, batch.column(1), pa.scalar(None, batch.column(1).type)),
                                          pa.array([b.astype("<u2").tobytes() for b in found], pa.binary())], names=["doc_id", "text_hash", "text", "buckets"])

    return map_arrow(docs, "doc_id long, text_hash long, text string, buckets binary", run)


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype="<u2").astype(np.int32) for b in batch.column(0).to_pylist()]


def add_in_levels(parts: DataFrame, tasks: int, total: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Adds up the partial sums of up to ``tasks`` tasks, ``FAN_IN`` at a time, so no group grows with the tasks.

    ``parts`` has rows (block, part, …), part being the number of the task; ``total`` adds the rows of one block and returns columns of the same names, with any part."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    while True:
        last = tasks <= FAN_IN
        parts = parts.withColumn("part", F.floor(F.col("part") / (tasks if last else FAN_IN)).cast("int")).groupBy("block", "part").applyInArrow(total, columns)
        if last:
            return parts
        tasks = -(-tasks // FAN_IN)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """(documents with a word of each bucket, number of documents, number of words), over all documents (buckets)."""

    def count(batches):
        seen, n, words = np.zeros(BUCKETS, dtype=np.int64), 0, 0
        for batch in batches:
            for buckets in _unpacked(batch):
                seen[np.unique(buckets)] += 1
                n += 1
                words += len(buckets)
        blocks = [(-1, [n, words])] + [(b, seen[b * BLOCK:(b + 1) * BLOCK]) for b in range(BUCKETS // BLOCK)]
        part = np.full(len(blocks), TaskContext.get().partitionId(), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array(part), pa.array([v for _, v in blocks], pa.list_(pa.int64()))], names=["block", "part", "sums"])

    def total(part: pa.Table) -> pa.Table:
        sums = np.sum([np.asarray(v.values) for v in part.column("sums")], axis=0)
        return pa.table({"block": part.column("block")[:1], "part": part.column("part")[:1], "sums": pa.array([sums], pa.list_(pa.int64()))})

    parts = docs.mapInArrow(count, "block int, part int, sums array<bigint>")
    table = add_in_levels(parts, docs.rdd.getNumPartitions(), total).toArrow()  # a number a bucket
    got = {b: np.asarray(v.values) for b, v in zip(table.column("block").to_pylist(), table.column("sums"))}
    if not got:
        return np.zeros(BUCKETS), 0, 0
    n, words = map(int, got.pop(-1))
    return np.concatenate([got[b] for b in sorted(got)]), n, words


def tfidf(buckets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a passage and their weights, of unit norm."""
    found, n = np.unique(buckets, return_counts=True)
    w = n * idf[found]
    return found, w / max(float(np.sqrt(w @ w)), 1e-12)


def item_passages(words: list[bytes]) -> list[list[bytes]]:
    """The passages of a benchmark item: all of its words up to WINDOW, else consecutive parts of that length at most."""
    parts = max(1, -(-len(words) // WINDOW))
    size = -(-len(words) // parts) if words else 0
    return [words[i:i + size] for i in range(0, len(words), size)] if words else []


def padded_halves(buckets: np.ndarray) -> np.ndarray:
    """The buckets in rows of half a window, the last one filled up with BUCKETS."""
    half = WINDOW // 2
    return np.concatenate([buckets, np.full(-len(buckets) % half, BUCKETS, dtype=np.int32)]).reshape(-1, half)


def add_products(texts: list[np.ndarray], idf: np.ndarray, weighed: np.ndarray, sums: np.ndarray) -> None:
    """Adds a (a V) for all passages a of the texts to ``sums``, without the idf of its rows' words.  ``weighed`` is V times idf with a row of zeros.

    A passage is the sum of two halves over its norm, so each half is multiplied once.  ``idf`` ends in a zero for BUCKETS.
    """
    texts = [t for t in texts if len(t)]
    if not texts:
        return
    halves = [padded_halves(t) for t in texts]
    h = np.concatenate(halves)
    ends = np.cumsum([len(x) for x in halves])
    pair = np.ones(len(h), dtype=bool)  # halves that start a passage of two
    pair[ends - 1] = False
    alone = np.zeros(len(h), dtype=bool)  # texts of one half
    alone[[e - 1 for e, x in zip(ends, halves) if len(x) == 1]] = True
    after = np.concatenate([h[1:], h[-1:]])
    both = np.sort(np.concatenate([h, np.where(pair[:, None], after, BUCKETS)], axis=1), axis=1)  # words of each passage
    flat = both.ravel()
    new = np.ones(both.shape, dtype=bool)
    new[:, 1:] = both[:, 1:] != both[:, :-1]
    first = np.flatnonzero(new.ravel())
    n = np.diff(np.append(first, flat.size))
    squares = np.bincount(first // both.shape[1], weights=(n * idf[flat[first]]) ** 2, minlength=len(h))
    over = np.where(pair | alone, 1.0 / np.maximum(squares, 1e-24), 0.0).astype(np.float32)  # of a and of V a: both over the norm
    z = weighed[h[:, 0]]
    for k in range(1, h.shape[1]):
        z += weighed[h[:, k]]
    y = z.copy()
    y[:-1] += z[1:] * pair[:-1, None]
    y *= over[:, None]
    back = y.copy()
    back[1:] += y[:-1] * pair[:-1, None]
    for i in range(0, len(h), TOGETHER):  # counts of each word in a few halves, times their rows
        own = h[i:i + TOGETHER]
        at, place = np.unique(own, return_inverse=True)
        m = len(own)
        counts = np.bincount(place.ravel() * m + np.repeat(np.arange(m), own.shape[1]), minlength=len(at) * m).reshape(len(at), m)
        k = len(at) - (at[-1] == BUCKETS)
        sums[at[:k]] += counts[:k].astype(np.float32) @ back[i:i + m]


def _rows_of(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def save(values: np.ndarray, uri: str) -> str:
    """Write an array as a file of the shared folder, which tasks ``load``."""
    with replaced_file(uri) as out:
        buffer = io.BytesIO()
        np.save(buffer, values)
        out.write(buffer.getbuffer())
    return uri


def load(uri: str) -> np.ndarray:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return np.load(io.BytesIO(f.read()))


def forget(uri: str) -> None:
    fs, path = open_fs(uri)
    fs.delete_dir(path.rsplit("/", 1)[0])


def fit_basis(rows: DataFrame, idf: np.ndarray, rank: int = RANK, steps: int = POWER_STEPS) -> np.ndarray:
    """An orthonormal basis (buckets x rank) of the leading right singular space of the TF-IDF passages of ``rows`` (buckets).

    Each step is one job: with the basis V of before, tasks sum a (a V) over their rows a, and their sums are added by word.
    Tasks read V from a file of the shared folder; the first V is random and made by each task alike.  The last sums are factored
    with their V (Nyström: A'A is about Y (V'Y)^-1 Y' for Y = A'A V), so one pass over the rows serves where a basis taken from
    the sums alone needs two.
    """
    spark, tasks = rows.sparkSession, rows.rdd.getNumPartitions()
    width, known = rank + OVERSAMPLE, None  # the file of the basis; at first it is random, made by each task alike
    ended = np.append(idf, 0.0)

    for step_no in range(steps + 1):

        def multiply(batches):
            weighed = random_basis(width) if known is None else load(known)
            weighed *= ended[:, None].astype(np.float32)
            sums = np.zeros((BUCKETS, width), dtype=np.float32)
            held, n, part = [], 0, TaskContext.get().partitionId()
            for batch in batches:
                for text in _unpacked(batch):
                    step = 1 << 14  # a long text goes in parts; the half window that two parts share ends one and starts the next
                    for at in range(0, max(1, len(text) - WINDOW // 2), step):
                        piece = text[at:at + step + WINDOW // 2]
                        held.append(piece)
                        n += len(piece)
                        if n >= step:
                            add_products(held, ended, weighed, sums)
                            held, n = [], 0
            add_products(held, ended, weighed, sums)
            used = np.flatnonzero(sums.any(axis=1))  # words that occur in the rows
            for i in range(0, len(used), BLOCK):
                own = used[i:i + BLOCK]
                values = (sums[own] * idf[own, None]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(own // 64, pa.int32()), pa.array(np.full(len(own), part, dtype=np.int32)), pa.array(own % 64, pa.int32()), _rows_of(values)],
                                                 names=["block", "part", "at", "sums"])

        def total(part: pa.Table) -> pa.Table:
            sums = np.zeros((64, width), dtype=np.float64)
            for batch in part.to_batches():
                values = batch.column("sums").flatten().to_numpy().reshape(-1, width)
                for k, row in zip(batch.column("at").to_pylist(), values):
                    sums[k] += row
            used = np.unique(part.column("at").to_numpy())
            same = {c: pa.array(np.full(len(used), part.column(c)[0].as_py(), dtype=np.int32)) for c in ("block", "part")}
            return pa.table(same | {"at": pa.array(used.astype(np.int32)), "sums": _rows_of(sums[used].astype(np.float32))})

        parts = rows.mapInArrow(multiply, "block int, part int, at int, sums array<float>")
        got = add_in_levels(parts, tasks, total).toArrow()  # a row for each bucket
        if not got.num_rows:
            return np.zeros((BUCKETS, 1), np.float32)
        bucket = got.column("block").to_numpy() * 64 + got.column("at").to_numpy()
        order = np.argsort(bucket)
        used = bucket[order]
        sums = got.column("sums").combine_chunks().values.to_numpy().reshape(-1, width)[order]
        del got
        if step_no < steps:
            q = np.linalg.qr(sums.astype(np.float64))[0]
            width = q.shape[1]
            basis = np.zeros((BUCKETS + 1, width), dtype=np.float32)
            basis[used] = q
            if known is not None:
                forget(known)
            known = save(basis, f"{fresh_dir(spark, 'basis')}/basis.npy")
            del basis
    tried = (random_basis(width) if known is None else load(known))[used]
    if known is not None:
        forget(known)
    directions = leading_directions(sums, tried, rank)
    basis = np.zeros((BUCKETS, directions.shape[1]), dtype=np.float32)
    basis[used] = directions
    return basis


def random_basis(width: int) -> np.ndarray:
    """The random matrix that the first step multiplies, the same wherever it is made."""
    return np.random.default_rng(7).standard_normal((BUCKETS + 1, width), dtype=np.float32)


def leading_directions(y: np.ndarray, v: np.ndarray, rank: int) -> np.ndarray:
    """Up to ``rank`` orthonormal eigenvectors of a positive matrix G, the largest eigenvalues first, from y = G v.

    G is shifted by what rounding may have taken from its smallest eigenvalues, so that v'y stays positive; directions that
    the shift alone explains are left out."""
    y = y.astype(np.float64)
    shift = math.sqrt(len(y)) * float(np.finfo(np.float32).eps) * float(np.linalg.norm(y, 2)) / max(float(np.linalg.norm(v, 2)), 1e-30)
    y += shift * v
    inner = v.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    keep = values > max(values[-1] * 1e-12, 0.0)
    if not keep.any():
        return np.zeros((len(y), 1))
    q, r = np.linalg.qr(y @ (vectors[:, keep] / np.sqrt(values[keep])))
    u, s, _ = np.linalg.svd(r)  # the squares of s are the eigenvalues of the shifted G
    return (q @ u[:, :max(1, np.count_nonzero(s * s > 2 * shift))])[:, :rank]


def unit_rows(z: np.ndarray) -> np.ndarray:
    """The rows divided by their norms; rows of zeros stay."""
    return z / np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), np.float32(1e-12))[:, None]


@dataclass
class Queries:
    """A block of benchmark items, ready to compare: one row a passage."""

    ids: list  # item_id of each item
    words: list[list[bytes]]
    answers: list[list[bytes]]
    item: np.ndarray  # of each passage
    vectors: np.ndarray  # basis columns x passages, of unit norm
    distinct: list[frozenset]  # the words of each item
    longest: int  # words of an item
    buckets: np.ndarray  # of the distinct words of all items with passages, one item after another
    first: np.ndarray  # where each of these items begins there
    of_passage: np.ndarray  # the place of each passage's item among them
    lengths: np.ndarray  # the number of words of each of them
    column: np.ndarray  # of each bucket in a table of the buckets of all items; 0 for others
    wanted: np.ndarray  # items with passages x the columns of their distinct words, WANTED of them at most, filled up with 0

    @classmethod
    def make(cls, items: list[tuple], basis: np.ndarray, idf: np.ndarray) -> Queries:
        words = [words_of(t) for _, t, _ in items]
        answers = [words_of(a) or w[-ANSWER_WORDS:] for (_, _, a), w in zip(items, words)]
        item, rows = [], []
        for i, w in enumerate(words):
            for part in item_passages(w):
                at, weights = tfidf(buckets_of(part), idf)
                item.append(i)
                rows.append(unit_rows((weights.astype(np.float32) @ basis[at])[None])[0])
        distinct = [frozenset(w) for w in words]
        with_words = sorted(set(item))
        sizes = np.array([len(distinct[i]) for i in with_words], dtype=np.int64)
        held = np.concatenate([buckets_of(list(distinct[i])) for i in with_words]) if with_words else np.zeros(0, np.int32)
        column = np.zeros(BUCKETS + 1, dtype=np.int32)
        column[np.unique(held)] = 1 + np.arange(len(np.unique(held)))
        wanted = np.zeros((len(with_words), min(max(sizes, default=0), WANTED)), dtype=np.int32)
        nth = np.arange(len(held)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wanted[np.repeat(np.arange(len(sizes)), sizes)[nth < WANTED], nth[nth < WANTED]] = column[held[nth < WANTED]]
        return cls([i for i, _, _ in items], words, answers, np.array(item, dtype=np.int64),
                   np.array(rows, dtype=np.float32).T if rows else np.zeros((basis.shape[1], 0), np.float32), distinct, max(map(len, words), default=0),
                   held, np.cumsum(sizes) - sizes, np.searchsorted(np.array(with_words, dtype=np.int64), np.array(item, dtype=np.int64)),
                   np.array([len(words[i]) for i in with_words], dtype=np.float64), column, wanted)

    def coverable(self, buckets: np.ndarray, least_cover: float) -> np.ndarray:
        """For each passage, whether a text of these buckets can cover its item: each distinct word whose bucket is missing lowers the cover."""
        there = np.zeros(BUCKETS + 1, dtype=bool)
        there[buckets] = True
        missing = np.add.reduceat((~there[self.buckets]).astype(np.int64), self.first)
        return (self.lengths - missing >= least_cover * self.lengths)[self.of_passage]

    def can_cover_any(self, buckets: np.ndarray, least_cover: float) -> bool:
        return len(self.of_passage) > 0 and len(buckets) > 0 and bool(self.coverable(buckets, least_cover).any())

    def coverable_near(self, buckets: np.ndarray, at: int, size: int, rows: np.ndarray, passages: np.ndarray, least_cover: float) -> np.ndarray:
        """For each pair of a window and a passage, whether the words around the window can cover the passage's item, by the same count.

        ``rows`` numbers the windows that start in the part of the text at ``at`` of ``size`` words, which begins with a half window; ``buckets`` are the whole text's.
        """
        half = WINDOW // 2
        lead = -(-self.longest // half)  # half windows that hold what an item is held against on either side
        begin = max(0, at - lead * half)
        own = buckets[begin:at + size + WINDOW + lead * half]
        shape = -(-len(own) // half) + 2 * lead + 2, int(self.column.max()) + 1
        if shape[0] * shape[1] > NEAR_BYTES:  # very long items: all pairs go on
            return np.ones(len(rows), dtype=bool)
        near = np.zeros(shape, dtype=bool)
        near[lead + np.arange(len(own)) // half, self.column[own]] = True
        near[:, 0] = True
        width, whole = 1, 2 + 2 * lead  # each row takes up those after it, twice as many in each step
        while width < whole:
            step = min(width, whole - width)
            near[:-step] |= near[step:]
            width += step
        flat, first, items = near.ravel(), (rows + (at - begin) // half) * near.shape[1], self.of_passage[passages]
        there = [np.count_nonzero(flat[first[i:i + BLOCK, None] + self.wanted[items[i:i + BLOCK]]], axis=1) for i in range(0, len(rows), BLOCK)]
        missing = self.wanted.shape[1] - np.concatenate(there)
        return self.lengths[items] - missing >= least_cover * self.lengths[items]


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """The length of the longest common subsequence (bit-parallel: one wide integer row over ``a``)."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for w in b:
        m = where.get(w, 0)
        if m:
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@dataclass
class Space:
    """The latent space: the basis with each word's row times its idf, and a row of zeros at the end."""

    rows: np.ndarray

    @classmethod
    def make(cls, basis: np.ndarray, idf: np.ndarray) -> Space:
        return cls(np.concatenate([basis * idf[:, None].astype(np.float32), np.zeros((1, basis.shape[1]), np.float32)]))

    @staticmethod
    @lru_cache(maxsize=1)
    def of(uri: str) -> Space:
        """The space whose rows are in a file, read once by each Python worker."""
        return Space(load(uri))


def cosines(buckets: np.ndarray, space: Space, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, cosine of each window with each query passage, a column of ``vectors``)."""
    starts = window_starts(len(buckets))
    sums = space.rows[padded_halves(buckets)].sum(axis=1)
    z = sums[:len(starts)].copy()
    if len(sums) > 1:
        z += sums[1:len(starts) + 1]
    return starts, unit_rows(z) @ vectors


def matches(text: str | pa.StringScalar, space: Space, queries: Queries, least_cosine: float, least_cover: float, buckets: np.ndarray | None = None) -> list[tuple[int, float, float]]:
    """(item index, best cosine, cover) of the items that a text holds; ``buckets`` are those of its words, if known."""
    words = None  # hashed texts are cut into words for windows that are compared word by word alone
    if buckets is None:
        words = words_of(text)
        buckets = buckets_of(words)
    if not len(buckets) or not queries.vectors.shape[1]:
        return []
    found: dict[int, tuple[float, float]] = {}
    for at in range(0, len(buckets), 1 << 14):  # windows start in this part of a long text
        part = buckets[at:at + (1 << 14) + WINDOW // 2]
        # all that the items are held against here
        whole = slice(max(0, at - queries.longest), at + len(part) + WINDOW + queries.longest)
        possible = np.flatnonzero(queries.coverable(buckets[whole], least_cover))
        if not len(possible):
            continue
        starts, cos = cosines(part, space, queries.vectors[:, possible])
        rows, columns = np.nonzero(cos >= least_cosine)
        if len(rows) > SOME_PAIRS:
            can = queries.coverable_near(buckets, at, len(part), rows, possible[columns], least_cover)
            rows, columns = rows[can], columns[can]
        if words is None and len(rows):
            words = words_of(text if isinstance(text, str) else text.as_py())
        last, widest, have = -1, 0, frozenset()
        for s, q, i in zip(rows.tolist(), columns.tolist(), queries.item[possible[columns]].tolist()):
            if found.get(i, (0, 0))[1] >= 1:
                continue
            item, answer, first = queries.words[i], queries.answers[i], at + s * (WINDOW // 2)
            if s != last or len(item) > widest:
                last, widest = s, max(WINDOW, len(item))
                have = frozenset(words[max(0, first - widest):first + WINDOW + widest])
            if len(item) - len(queries.distinct[i] - have) < least_cover * len(item):  # each word that is missing lowers the cover
                continue
            around = words[max(0, first - len(item)):first + WINDOW + len(item)]
            cover = lcs(item, around) / len(item)
            if cover >= least_cover and lcs(answer, around) >= least_cover * len(answer):
                best = found.get(i, (0.0, 0.0))
                found[i] = max(best[0], float(cos[s, q])), max(best[1], cover)
    return [(i, c, cover) for i, (c, cover) in sorted(found.items())]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, least_cosine: float = LEAST_COSINE, least_cover: float = LEAST_COVER, rank: int = RANK,
                   items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """Rows (doc_id, text_hash, item_ids, cosine, cover), one for each row of ``docs`` that holds one or more benchmark items
    (in a benchmark of more than ``items_a_pass`` items one for each block that the row holds items of)."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select("item_id", text_of().alias("text"), answer.alias("answer"))
    n_items = items.count()
    blocks = max(1, -(-n_items // items_a_pass))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("text_hash"))
    # texts that cannot cover an item are set aside at once, the others kept with their buckets, so words are hashed once
    whole = [tuple(r) for r in items.collect()] if blocks == 1 else None
    kept = materialize(bucketed_documents(source, whole, least_cover), "words")
    hashed = kept.select("buckets")
    seen, n_docs, n_words = document_frequencies(hashed)
    idf = np.log((n_docs + 1) / (seen + 0.5)).clip(0.0)
    tasks = max(3, math.ceil(n_words / WORDS_A_TASK))
    basis = fit_basis(hashed.unionByName(bucketed(items.select("text"))).coalesce(tasks), idf, rank)
    space = save(Space.make(basis, idf).rows, f"{fresh_dir(docs.sparkSession, 'space')}/space.npy")
    source = kept.where("text IS NOT NULL").select("doc_id", "text", "text_hash", "buckets")
    out = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # about items_a_pass queries
        queries = Queries.make([tuple(r) for r in own], basis, idf)

        def run(batch: pa.RecordBatch, queries=queries):
            rows = []
            for k, (text, buckets) in enumerate(zip(batch.column(1), _unpacked(batch.select([3])))):
                hit = matches(text, Space.of(space), queries, least_cosine, least_cover, buckets)
                if hit:
                    ids = sorted({queries.ids[i] for i, _, _ in hit if queries.ids[i] is not None})
                    rows.append((k, ids, max(c for _, c, _ in hit), max(c for _, _, c in hit)))
            if rows:
                take = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                                                  pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows])],
                                                 names=["doc_id", "text_hash", "item_ids", "cosine", "cover"])

        part = map_arrow(source, "doc_id long, text_hash long, item_ids array<bigint>, cosine double, cover double", run)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns unchanged."""
    bad = find_benchmark(docs.select("doc_id", "text"), benchmark, **options)
    bad = materialize(bad.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "contaminated", narrow=True)
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(text_of()) == bad["bad_hash"]), "left_anti")

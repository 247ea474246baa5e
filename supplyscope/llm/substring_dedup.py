"""Exact substring dedup: interval expansion on a Burrows-Wheeler transform, bounded by a threshold.

Removes every byte covered by a string of ``least`` bytes that also starts anywhere else, the same document included.

1. Equal texts are kept once with their number of copies, in a table bucketed by the text's hash, so later joins leave texts in place.
2. Each window of ``least`` bytes is named by the smallest hash of the ``GRAM``-byte strings in it (winnowing).  Equal windows have equal names, so what repeats meets under one name.
   Runs of windows with one name make a context, the bytes they cover.  Names that occur once in the whole corpus are dropped: none of their windows repeats,
   unless the context holds the string of its name twice, as periodic text does.
3. Contexts that are equal as a whole are kept once with their number.  A name with one context only needs no more: its windows repeat
   as often as the context, unless it is such a periodic one.
4. The contexts of the other names are dealt to groups of about ``GROUP_BYTES`` by name.  A task builds the suffix array and the Burrows-Wheeler transform
   of its group and finds the boundaries between suffixes by increasing common prefix (Beller, Gog, Ohlebusch and Schnattinger, 2013): level 0 are the
   changes of the first byte; a boundary at one level, extended backward by each byte that occurs on both of its sides, is a boundary of the next.
   The expansion is breadth first and stops at ``least``: suffixes that no boundary separates then share that many bytes.
5. A name with more than ``MANY`` contexts, as of a passage that a third of all documents hold, is not put into one task: its windows
   are counted by two 64-bit hashes of their bytes, with a map-side part.

Defined cases: null text is empty; texts shorter than ``least`` lose nothing; very long texts are cut into windows piece by piece; repeated rows are occurrences of their own, so from
``least`` bytes on they lose everything; null doc_ids are kept in the result; an empty table gives no rows.  Only doc_id and text are read.  Texts and contexts are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.llm.common import discard, fresh_dir, map_arrow, materialize, text_of

GRAM = 32
PIECE = 1 << 20  # windows named at a time
LONGEST_RUN = 1024  # windows in a context
GROUP_BYTES = 1 << 20
MANY = 1024
NEAR = 24  # suffixes behind a boundary that are looked at one by one


# ---- names of windows --------------------------------------------------------------------------------------------

def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every GRAM bytes, by doubling the length that is hashed."""
    with np.errstate(over="ignore"):
        h, base, width = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
        while width < GRAM:
            h = h[:len(h) - width] * np.uint64(base) + h[width:]
            base, width = base * base % (1 << 64), 2 * width
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive values."""
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(x)] = x
    square = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(back[:n], ahead[w - 1:w - 1 + n])


def contexts_of(text: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[bool]]:
    """(name, first window, last window, hash of the bytes, whether windows may repeat inside) of each context of a text.

    Equal windows inside one context hold the string that gives the name at two places, so its hash is found there twice.
    """
    names, firsts, lasts, inner = [], [], [], []
    width = least - GRAM + 1
    data = np.frombuffer(text, dtype=np.uint8)
    for at in range(0, len(text) - least + 1, PIECE):
        g = _gram_hashes(data[at:at + PIECE + least - 1])
        m = _sliding_min(g, width)
        cut = np.flatnonzero(np.diff(m)) + 1
        first = np.concatenate([[0], cut])
        length = np.diff(np.concatenate([first, [len(m)]]))
        parts = -(-length // LONGEST_RUN)
        if parts.max() > 1:
            step = np.concatenate([np.arange(p) for p in parts]) * LONGEST_RUN
            first, end = np.repeat(first, parts) + step, np.repeat(first + length, parts)
            last = np.minimum(first + LONGEST_RUN, end) - 1
        else:
            last = first + length - 1
        names.append(m[first])
        inner += [np.count_nonzero(g[a:b + width] == x) > 1 for a, b, x in zip(first.tolist(), last.tolist(), m[first])]
        firsts.append(first + at)
        lasts.append(last + at)
    if not names:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), [], []
    first, last = np.concatenate(firsts), np.concatenate(lasts)
    view = memoryview(text)
    marks = [xxhash.xxh3_64_intdigest(view[a:b + least]) for a, b in zip(first.tolist(), last.tolist())]
    return np.concatenate(names), first, last, marks, inner


# ---- Burrows-Wheeler transform -----------------------------------------------------------------------------------

def suffix_array(codes: np.ndarray) -> np.ndarray:
    """The order of the suffixes of an array of codes below 512, by doubling from seven codes; only unsettled suffixes are sorted again."""
    n = len(codes)
    wide = np.concatenate([codes, np.zeros(7, codes.dtype)]).astype(np.int64)
    key = np.zeros(n, dtype=np.int64)
    for j in range(7):
        key = key << 9 | wide[j:j + n]
    order = np.argsort(key)
    first = np.concatenate([[True], np.diff(key[order]) != 0])
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # the first place of each class
    h = 7
    while True:
        alone = first & np.concatenate([first[1:], [True]])
        open_at = np.flatnonzero(~alone)  # places of unsettled suffixes; their classes are whole ranges of places
        if not len(open_at):
            return order
        sub = order[open_at]
        pair = rank[sub] * (n + 1) + rank[np.minimum(sub + h, n)] + 1  # the class, and that of what follows
        again = np.argsort(pair)
        sub, pair = sub[again], pair[again]
        order[open_at] = sub
        new = np.concatenate([[True], np.diff(pair) != 0])
        first[open_at] = new
        rank[sub] = np.maximum.accumulate(np.where(new, open_at, 0))
        h *= 2


def common_from(codes: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place in the suffix order, whether its suffix shares fewer than ``least`` codes with the one before.

    Code 0 separates texts: common prefixes are not followed across it, so the answer holds for suffixes with ``least`` codes before the next 0.
    """
    n = len(codes)
    bwt = codes[order - 1]  # the code before each suffix
    found, count = np.unique(bwt, return_counts=True)
    start = np.cumsum(count) - count
    split = np.zeros(n + 1, dtype=bool)
    split[start] = True
    split[n] = True
    level = start  # common prefix 0: the first code changes
    letters = np.flatnonzero(found)
    # occurrences of each code up to any place: a bitmap by code, and the count before each 64 bits
    words = n // 64 + 1
    bits = np.zeros((len(letters), words), dtype=np.uint64)
    for i, k in enumerate(letters):
        packed = np.packbits(bwt == found[k], bitorder="little")
        bits[i].view(np.uint8)[:len(packed)] = packed
    ones = np.bitwise_count(bits).astype(np.int32)
    low, high = start[letters].astype(np.int32)[:, None], (start + count)[letters].astype(np.int32)[:, None]
    before = np.cumsum(ones, axis=1, dtype=np.int32) - ones + low  # the place of the next suffix that begins with the code
    by_code = np.argsort(bwt, kind="stable")  # the code's occurrences, in the order of the suffixes that begin with them
    next_place = np.empty(n, dtype=np.int64)  # of each place, that of the suffix which the code before it begins
    next_place[by_code] = np.arange(n)
    last_same = np.empty(n, dtype=np.int64)  # the place before with the same code; n if there is none, or for code 0
    last_same[by_code[1:]] = by_code[:-1]
    last_same[by_code[start]] = n
    last_same[bwt == 0] = n
    for _ in range(1, least):
        if not len(level):
            break
        # the suffixes behind each boundary, up to the next boundary: one whose code occurs before the boundary too begins a new one
        to, here, at = [], level, level
        for _ in range(NEAR):
            to.append(next_place[at[last_same[at] < here]])
            going = ~split[at + 1]
            here, at = here[going], at[going] + 1
            if not len(here):
                break
        for part in np.array_split(here, -(-len(here) // 1024)) if len(here) else []:  # many suffixes follow: extend by every code
            word, below = part >> 6, (np.uint64(1) << (part & 63).astype(np.uint64)) - np.uint64(1)
            places = np.take(before, word, axis=1) + np.bitwise_count(np.take(bits, word, axis=1) & below)
            to.append(places[(places > low) & (places < high)].astype(np.int64))  # the code occurs before and after the boundary
        new = np.concatenate(to)
        level = np.unique(new[~split[new]])
        split[level] = True
    return split[:n]


def repeated_windows(contexts: list[bytes], copies: np.ndarray, least: int) -> list[np.ndarray]:
    """For each context, whether each of its windows of ``least`` bytes occurs twice or more in all, copies counted."""
    lengths = np.array([len(c) for c in contexts])
    ends = np.cumsum(lengths + 1)
    codes = np.zeros(ends[-1], dtype=np.int16)
    starts = ends - lengths - 1
    for s, c in zip(starts, contexts):
        codes[s:s + len(c)] = np.frombuffer(c, dtype=np.uint8).astype(np.int16) + 1
    order = suffix_array(codes)
    group = np.cumsum(common_from(codes, order, least))
    owner = np.searchsorted(ends, order, side="right")
    valid = order - starts[owner] <= lengths[owner] - least
    weight = np.bincount(group[valid], weights=copies[owner[valid]], minlength=group[-1] + 1)
    hit = np.zeros(len(codes), dtype=bool)
    hit[order[valid]] = weight[group[valid]] >= 2
    return [hit[s:s + n - least + 1] for s, n in zip(starts, lengths)]


def runs_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


# ---- tables ------------------------------------------------------------------------------------------------------

def _bucketed_texts(docs: DataFrame) -> tuple[DataFrame, str]:
    """(rows (h, text, copies): each distinct text once, bucketed by its hash; the name of their table)."""
    spark = docs.sparkSession
    texts = docs.select(text_of().alias("text")).withColumn("h", F.xxhash64("text")).groupBy("h").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    path = fresh_dir(spark, "texts")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.write.bucketBy(buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
    return spark.table(name), name


def repeated_runs(texts: DataFrame, least: int) -> DataFrame:
    """Rows (h, first, last): runs of windows of the text that occur twice or more in the corpus."""

    def cut(batch: pa.RecordBatch):
        cols: list[list] = [[] for _ in range(7)]
        for h, text, copies in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            name, first, last, marks, inner = contexts_of(text.as_buffer().to_pybytes(), least)
            if len(name):
                for c, v in zip(cols, (name.view(np.int64), np.array(marks, dtype=np.uint64).view(np.int64), np.full(len(name), h), first, last, np.full(len(name), copies), np.array(inner, dtype=np.int64))):
                    c.append(v)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], names=["name", "mark", "h", "first", "last", "copies", "inner"])

    cuts = materialize(map_arrow(texts.select("h", "text", "copies"), "name long, mark long, h long, first long, last long, copies long, inner long", cut), "contexts")
    kinds = (cuts.withColumn("n", F.col("last") - F.col("first") + 1).groupBy("name", "mark", "n")
             .agg(F.sum("copies").alias("copies"), F.max("inner").alias("inner"), F.min(F.struct("h", "first")).alias("at")))
    names = kinds.groupBy("name").agg(F.count("*").alias("kinds"), F.sum("copies").alias("total"), F.max("inner").alias("any"))
    kinds = materialize(kinds.join(names.where("total > 1 OR any > 0"), "name"), "kinds")
    # the windows of a context that occurs twice repeat; others of its name are looked into
    whole = kinds.where("copies > 1").select("name", "mark", "n", F.lit(0).cast("long").alias("lo"), (F.col("n") - 1).alias("hi"))
    asked = kinds.where("kinds > 1 OR inner > 0").select("name", "mark", "n", "copies", "kinds", F.col("at.h").alias("h"), F.col("at.first").alias("first"))
    held = asked.join(texts.select("h", "text"), "h").select(
        "name", "mark", "n", "copies", "kinds", F.substring(F.col("text").cast("binary"), (F.col("first") + 1).cast("int"), (F.col("n") + least - 1).cast("int")).alias("bytes"))
    held = materialize(held, "context-bytes")
    volume = held.where(F.col("kinds") <= MANY).agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    groups = max(1, -(-volume // GROUP_BYTES))

    def expand(part: pa.Table) -> pa.Table:
        rows = [part.column(c).to_pylist() for c in ("name", "mark", "n", "bytes")]
        hits = repeated_windows(rows[3], part.column("copies").to_numpy().astype(np.float64), least)
        runs = [runs_of(h) for h in hits]
        count = [len(lo) for lo, _ in runs]
        out = {c: pa.array(np.repeat(np.array(v, dtype=np.int64), count)) for c, v in zip(("name", "mark", "n"), rows)}
        return pa.table(out | {"lo": pa.array(np.concatenate([lo for lo, _ in runs]).astype(np.int64)), "hi": pa.array(np.concatenate([hi for _, hi in runs]).astype(np.int64))})

    few = (held.where(F.col("kinds") <= MANY).withColumn("g", F.pmod(F.xxhash64("name"), F.lit(groups))).groupBy("g")
           .applyInArrow(expand, "name long, mark long, n long, lo long, hi long"))
    window = F.substring(F.col("bytes"), F.col("lo") + 1, F.lit(least))
    many = (held.where(F.col("kinds") > MANY).select("*", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("lo"))
            .select("name", "mark", "n", "copies", "lo", F.xxhash64(window).alias("w1"), F.xxhash64(F.lit(1), window).alias("w2")))
    twice = many.groupBy("w1", "w2").agg(F.sum("copies").alias("all")).where("all > 1").select("w1", "w2")
    many = many.join(twice, ["w1", "w2"]).select("name", "mark", "n", F.col("lo").cast("long").alias("lo"), F.col("lo").cast("long").alias("hi"))
    found = materialize(whole.unionByName(few).unionByName(many), "repeats")
    return cuts.withColumn("n", F.col("last") - F.col("first") + 1).join(found, ["name", "mark", "n"]).select(
        "h", (F.col("first") + F.col("lo")).alias("first"), (F.col("first") + F.col("hi")).alias("last"))


def merged_spans(first: np.ndarray, last: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The bytes that runs of windows cover, as maximal spans (start, end)."""
    order = np.argsort(first, kind="stable")
    start, end = first[order], np.maximum.accumulate(last[order]) + least
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return list(zip(start[new].tolist(), end[np.concatenate([new[1:], [True]])].tolist()))


def remove_repeats(docs: DataFrame, least: int = 400, with_text: bool = False) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), one for each row of ``docs``; kept are the remaining bytes."""
    texts, name = _bucketed_texts(docs)
    runs = repeated_runs(texts, least).groupBy("h").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    joined = texts.join(runs.withColumnRenamed("h", "run_h"), F.col("h") == F.col("run_h"), "left").select("h", "text", "first", "last")
    names = ["h", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def cut(batch: pa.RecordBatch):
        rows = []
        for h, text, first, last in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2, 3))):
            data = text.as_buffer().to_pybytes()
            spans = merged_spans(np.asarray(first.values), np.asarray(last.values), least) if first.is_valid and len(first.values) else []
            edges = [0, *(x for s in spans for x in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append((h, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) + (kept,) * with_text)
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    by_text = materialize(map_arrow(joined, "h long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text, cut), "kept")
    discard(texts)
    docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("row_h"))
    return rows.join(by_text, F.col("row_h") == F.col("h")).select("doc_id", *names[1:])

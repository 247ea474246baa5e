"""Best-fit packing of token sequences after Martello and Toth's dominance reduction.

1. Tasks encode whole texts, append an end id and cut documents longer than ``capacity`` into pieces; no other document is cut.  A row a piece is written, with
   its number among the pieces of its length in its partition.
2. Pieces of one length are exchangeable, so the instance is its histogram: at most ``capacity`` rows, whatever the number of documents.
3. Reduction (Martello and Toth, "Lower bounds and reduction procedures for the bin packing problem", 1990): from the longest piece down, a set of at most three pieces that
   provably dominates every other set with that piece is fixed as a sequence, as many times as the counts allow; what is left is a smaller instance, and is reduced again until nothing
   is fixed.  A piece is fixed alone if nothing fits beside it; with a piece that fills the sequence; with the longest that fits, if no two fit, or if no three fit
   and no two are longer together; and with the longest and a further one, if no three fit and these two are at least as long, one by one, as any two that fit.
4. Best fit of the remainder by falling length: each piece goes into the sequence with the least room that takes it.  Sequences of equal contents are one group, so this takes
   a few steps for each length instead of one for each piece.
5. The groups become ranges of piece numbers by length.  A piece's number among all pieces of its length is its number in the partition and the count in the partitions before;
   a search among the ranges gives its sequence and offset.  So no length, however frequent, is sorted or ranked in one task.

Defined cases: a null or empty text is the end id alone; a text of exactly ``capacity`` ids with its end is one piece; repeated rows and rows without a doc_id are pieces of
their own; a very long text is encoded whole and cut into pieces; ties go to the shorter contents first met, so a run on the same files gives the same sequences; an empty table gives no rows.
Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplyscope.llm.common import fresh_dir, map_arrow, materialize, text_of
from supplyscope.llm.files import open_fs, replaced_file

CAPACITY = 2048
MAX_CACHED = 400_000  # words whose ids a task remembers; others are encoded again each time
GAP = re.compile("[ \t\r\n]+")
MARKS = ".,;:!?()[]{}\"*&#$%|-"


# ---- encoding ----------------------------------------------------------------------------------------------------

class Words(dict):
    """Ids of words as packed 32-bit integers, filled as words are met.

    Where the tokenizer's first cut drops white space and keeps runs of letters apart, a text is cut at white space, and a Latin word with marks behind it into
    letters and marks; any other word, and with any other tokenizer the whole text, is encoded by the library's full path.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        cut, normal = str(self.tokenizer.pre_tokenizer), str(self.tokenizer.normalizer)
        self.by_word = cut.startswith("Sequence(pretokenizers=[Split(") and "behavior=Removed, invert=True" in cut and "[^\\s\\p{L}\\p{N}]+" in cut
        self.by_word &= not any(GAP.search(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.by_letters = self.by_word and "[\\p{L}]+|" in cut and cut.endswith("ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])") and re.fullmatch(
            r"Sequence\(normalizers=\[NFC\(\), Replace\(pattern=Regex\(.*\), content=\" \"\), Lowercase\(\)\]\)", normal) is not None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        self.byte_letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.model = self.tokenizer.model

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def latin(self, word: str) -> bytes:
        piece = word.lower().encode().decode("latin-1").translate(self.byte_letters)
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        body = word.rstrip(MARKS) if self.by_letters else ""
        if body and body.isalpha() and max(body) < "\u0250" and "\u0130" not in body:  # one run of letters, each lower-cased to one letter
            ids = self.latin(word) if body == word else self[body] + self[word[len(body):]]
        else:
            ids = self.whole(word) if word else b""
        if len(self) < MAX_CACHED and len(word) <= 40:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, GAP.split(text))) if self.by_word else self.whole(text)


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, part, nth[, ids]): part is the partition, nth the number of the piece among its pieces of that length."""

    def run(batches):
        words, end, part = words_of(tokenizer), np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, dtype=np.int64)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = words.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[at:at + 4 * capacity]
                    n = len(own) // 4
                    row = (doc_id, k, at // 4, n, zlib.crc32(own), part, int(met[n])) + (np.frombuffer(own, "<u4").astype(np.int32),) * with_ids
                    met[n] += 1
                    for c, v in zip(cols, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t")).mapInArrow(run, schema)


# ---- the instance as a histogram ---------------------------------------------------------------------------------

@dataclass
class Group:
    """``count`` sequences of equal contents: (length, how many) in the order in which they lie."""

    count: int
    contents: list[tuple[int, int]]


class Lengths:
    """The lengths that are left, with their counts, in rising order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {n: c for n, c in counts.items() if c > 0}
        self.order = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.order.pop(bisect_left(self.order, length))

    def put(self, length: int, n: int) -> None:
        if length not in self.counts:
            insort(self.order, length)
        self.counts[length] = self.counts.get(length, 0) + n

    def longest(self, room: int) -> int | None:
        """The longest length of at most ``room``."""
        at = bisect_left(self.order, room + 1)
        return self.order[at - 1] if at else None

    def shortest(self, n: int) -> list[int]:
        """The n shortest pieces (fewer if there are no more)."""
        out: list[int] = []
        for length in self.order:
            out += [length] * min(self.counts[length], n - len(out))
            if len(out) == n:
                break
        return out

    def best_pair(self, room: int) -> int:
        """The greatest sum of two pieces that fit into ``room`` together, 0 if none do."""
        best, low, high = 0, 0, bisect_left(self.order, room) - 1
        while low <= high:
            a, b = self.order[low], self.order[high]
            if a + b > room or (low == high and self.counts[a] < 2):
                high -= 1
                if a + b <= room:
                    break
            else:
                best = max(best, a + b)
                low += 1
        return best

    def second_of_best(self, room: int, first: int) -> int | None:
        """The longest piece that fits into ``room`` beside ``first``, if every two that fit are no longer than the two, one by one; else None."""
        self.take(first, 1)
        try:
            second = self.longest(room - first)
            if second is None:
                return None
            above = bisect_left(self.order, second + 1)  # two longer than second must not fit (first itself is among the longer ones if it is left)
            longer = [x for x in self.order[above:above + 2] for _ in range(min(2, self.counts[x]))][:2]
            if first > second:
                longer = sorted([*longer, first])[:2]
            return second if len(longer) < 2 or sum(longer) > room else None
        finally:
            self.put(first, 1)


def dominating_set(left: Lengths, j: int, capacity: int) -> tuple[int, ...] | None:
    """The pieces beside one of length ``j`` (not counted in ``left``) of a set that dominates all others with it, or None if no rule proves one."""
    room = capacity - j
    k = left.longest(room)
    if k is None:
        return ()
    if k == room:
        return (k,)
    few = left.shortest(3)
    if len(few) < 2 or few[0] + few[1] > room:
        return (k,)
    if len(few) < 3 or sum(few) > room:
        if left.best_pair(room) <= k:
            return (k,)
        second = left.second_of_best(room, k)
        if second is not None:
            return (k, second)
    return None


def reduce_instance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Group], dict[int, int]]:
    """(sequences that are fixed, the histogram that is left)."""
    left, fixed = Lengths(counts), []
    again = True
    while again:
        again = False
        for j in sorted(left.counts, reverse=True):
            while left.counts.get(j):
                left.take(j, 1)
                beside = dominating_set(left, j, capacity)
                left.put(j, 1)
                if beside is None:
                    break
                used = [j, *beside]
                # taking pieces away keeps each rule true as long as the pieces themselves last
                times = min(left.counts[x] // used.count(x) for x in set(used))
                for x in set(used):
                    left.take(x, times * used.count(x))
                fixed.append(Group(times, [(x, used.count(x)) for x in dict.fromkeys(used)]))
                again = True
    return fixed, left.counts


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    """Best fit by falling length, in groups of sequences with equal contents."""
    rooms: dict[int, list[Group]] = {}
    order: list[int] = []  # rooms that some group has

    def open_group(room: int, group: Group) -> None:
        if room not in rooms:
            insort(order, room)
        rooms.setdefault(room, []).append(group)

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(order, length)
            room = order[at] if at < len(order) else capacity
            per = min(room // length, n)  # the sequence keeps the least room until no more fit
            if at < len(order):
                group = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
            else:
                group = Group(n // per, [])
            used = min(group.count, n // per)
            if used < group.count:
                open_group(room, Group(group.count - used, list(group.contents)))
            open_group(room - per * length, Group(used, [*group.contents, (length, per)]))
            n -= used * per
    return [g for room in order for g in rooms[room]]


@dataclass
class Places:
    """Ranges of piece numbers: pieces of ``length`` from number ``first`` on lie in sequences from ``base`` on, ``per`` in each from ``offset`` on."""

    length: np.ndarray
    first: np.ndarray
    base: np.ndarray
    per: np.ndarray
    offset: np.ndarray
    edges: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.edges = (self.length << 44) + self.first

    @classmethod
    def of(cls, groups: list[Group]) -> Places:
        rows, met, base = [], {}, 0
        for g in groups:
            offset = 0
            for length, per in g.contents:
                rows.append((length, met.get(length, 0), base, per, offset))
                met[length] = met.get(length, 0) + per * g.count
                offset += length * per
            base += g.count
        return cls(*(np.array(c, dtype=np.int64) for c in (zip(*sorted(rows)) if rows else [[]] * 5)))

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces of a length and number."""
        at = np.searchsorted(self.edges, (length << 44) + number, side="right") - 1
        beyond = number - self.first[at]
        return self.base[at] + beyond // self.per[at], self.offset[at] + beyond % self.per[at] * length


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    """All sequences of an instance: those fixed by dominance, then best fit of the rest."""
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


# ---- tables ------------------------------------------------------------------------------------------------------

def place_pieces(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored rows of ``pieces`` and drops part and nth."""
    spark = cut.sparkSession
    by_part = materialize(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths", narrow=True)
    found = by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    places = Places.of(pack_histogram({r["length"]: r["n"] for r in found}, capacity))
    uri = f"{fresh_dir(spark, 'places')}/places.npy"
    with replaced_file(uri) as out:  # a few rows for each length
        buffer = io.BytesIO()
        np.save(buffer, np.array([places.length, places.first, places.base, places.per, places.offset]))
        out.write(buffer.getbuffer())
    before = by_part.select(F.col("part").alias("in_part"), F.col("length").alias("of_length"),
                            (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    joined = cut.join(before, (F.col("part") == F.col("in_part")) & (F.col("length") == F.col("of_length")))
    own = [c for c in cut.columns if c not in ("part", "nth")]
    numbered = joined.select(*own, (F.col("before") + F.col("nth")).alias("number"))
    loaded: list[Places] = []

    def run(batch: pa.RecordBatch):
        if not loaded:
            fs, path = open_fs(uri)
            with fs.open_input_file(path) as f:
                loaded.append(Places(*np.load(io.BytesIO(f.read()))))
        sequence, offset = loaded[0].find(batch.column("length").to_numpy(), batch.column("number").to_numpy())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(sequence), pa.array(offset)], names=[*own, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in own)
    return map_arrow(numbered, f"{schema}, sequence_id long, offset long", run)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), one for each piece; sequences are numbered from 0 without a gap.

    ``tokenizer`` is a tokenizers JSON file on every machine.
    """
    return place_pieces(materialize(pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids, doc_ids, starts): the packed sequences, from rows of ``pack`` with ids; a sequence holds ``capacity`` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))

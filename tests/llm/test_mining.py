"""Filter audit, hard negatives and packing against plain versions."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from supplyscope.llm import filter_audit, hard_negatives, packing
from supplyscope.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF0001
from tests.llm.helpers import ODD, docs, prose
from tests.oracle_compare import compare, duck

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# ---- filter interaction audit ------------------------------------------------------------------------------------

def plain_audit(rows, labels):
    good, toxic = ({x[0] for x in labels if x[0] is not None and x[k] == 1} for k in (1, 2))
    found = []
    for d, t, lang, *_ in rows:
        t, words = t or "", re.findall("[^\x20\x09-\x0d]+", t or "")
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": re.search("[#$%&*|]", t) is not None,
                 "E": d is not None and any(e is not None and e < d and (u or "") == t for e, u, *_ in rows)}
        found.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out, shapley = {}, {}
    for part in {p for p, *_ in found}:
        own = [f[1:] for f in found if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                early = set(order[:k])
                removed = [x for x in own if f in x[0] and not x[0] & early]
                out[part, "".join(order), k + 1] = (sum(not x[0] & (early | {f}) for x in own), len(removed), sum(f in x[0] and bool(x[0] & early) for x in own),
                                                    sum(x[0] == {f} for x in own), sum(x[1] for x in removed), sum(x[2] for x in removed))
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def audited(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in names) for r in df.collect()}


def test_audit_equals_plain_orders(spark):
    rng = random.Random(4)
    long = [prose(rng, 260) for _ in range(4)]
    rows = [*ODD, (7, long[0], "en", "s", 1), (8, long[0], "de", "s", 1), (9, long[0] + " $", "", "s", 1), (10, long[0] + " $", None, "s", 1), (11, "Aa " * 300, "en", None, 1),
            (12, "Aa " * 300, "en", None, 1), (13, long[1].upper(), "en", "s", 1), (None, long[1].upper(), "en", "s", 1), (14, long[2], "en", "s", 1), (15, "a\x85b c \x0b\x0c", "fr", "s", 1)]
    labels = [(7, 1, 0), (8, 1, 1), (8, 0, 0), (12, None, 1), (13, 1, None), (99, 1, 1), (None, 1, 1), (2, 1, 0), (3, 0, 1)]
    got = audited(filter_audit.audit_filters(docs(spark, rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    want = plain_audit(rows, labels)
    assert got == want and len(got) == 600 * len({(r[2] or "") for r in rows})


def test_audit_of_equal_hashes_compares_texts(spark):
    """A row whose hash is in the marks' table but whose text is another one is no copy."""
    rows = docs(spark, [(1, "x"), (2, "x"), (3, "y")])
    bits = {r.doc_id: r.bits for r in filter_audit.failure_bits(rows).collect()}
    assert bits[2] & 16 and not bits[1] & 16 and not bits[3] & 16


def test_audit_without_documents_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs(spark, []), none).collect() == []
    got = audited(filter_audit.audit_filters(docs(spark, ODD), none))
    assert got == plain_audit(ODD, [])


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_hard_negatives"])
def test_query_equals_sql(spark, name):
    r = compare(QUERIES[name](spark, SF0001), duck(SF0001), ORACLE_SQL[name])
    assert r["ok"], r


# ---- hard negatives ----------------------------------------------------------------------------------------------

def plain_negatives(rows):
    held = {}
    for i, e, label in rows:
        if i is None or e is None or label is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        row = (label, [math.floor(256 * x) for x in e])
        held[i] = min(held.get(i, row), row)
    out = set()
    for a, (label, v) in held.items():
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (other, w) in held.items() if i != a and len(w) == len(v)]
        for ps, p, _ in sorted(s for s in scored if s[2])[:5]:
            fits = sorted(s for s in scored if not s[2] and 80 * -ps <= 100 * -s[0] <= 100 * -ps)[:5]
            out |= {(a, p, k + 1, i, -ps, -s) for k, (s, i, _) in enumerate(fits)}
    return out


def mined(df, **options):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return {tuple(r[c] for c in names) for r in hard_negatives.mine_hard_negatives(df, **options).collect()}


VECTORS = "vec_id long, embedding array<double>, label int"


def vector_fixture():
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(600):
        k = rng.randrange(5)
        rows.append((i, [c + rng.gauss(0, 0.2) for c in centres[k]], k if rng.random() < 0.7 else rng.randrange(5)))
    rows += [(600 + i, [0.5] * 6, i % 2) for i in range(250)]  # copies of one vector: ties everywhere
    rows += [(900, None, 1), (901, [1.0] * 6, None), (902, [1.0, None, 0.0], 1), (903, [float("nan")] * 6, 1), (904, [float("inf")] * 6, 1), (None, [1.0] * 6, 1),
             (1000, [3.0, -2.0], 1), (1001, [2.5, -2.0], 1), (1002, [2.4, -2.0], 2), (1100, [], 3), (1200, [9.0, 9.0, 9.0], 4), (5, [0.1] * 6, 0), rows[7], rows[7]]
    return rows


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 60)  # many tiles and slabs
    monkeypatch.setattr(hard_negatives, "ANCHORS_A_BLOCK", 3)
    rows = vector_fixture()
    frame = spark.createDataFrame(rows, VECTORS)
    for c in ("v", "dim", "tile", "slab", "a", "b", "row", "rank", "low", "high", "block"):
        frame = frame.withColumn(c, F.lit("x"))
    want = plain_negatives(rows)
    assert len(want) > 50
    assert mined(frame) == want


def test_tiles_split_copies_of_one_vector(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 50)
    rows = [(i, [1.0, 2.0], 0) for i in range(1000)]
    placed, tiles = hard_negatives.tiled(hard_negatives.integer_vectors(spark.createDataFrame(rows, VECTORS)))
    sizes = [r["count"] for r in placed.groupBy("tile").count().collect()]
    assert tiles >= 20 and sum(sizes) == 1000 and max(sizes) <= 100


def test_hard_negatives_of_nothing(spark):
    assert mined(spark.createDataFrame([], VECTORS)) == set()
    assert mined(spark.createDataFrame([(100, [1.0], 0)], VECTORS)) == set()


def test_large_components_are_compared_exactly(spark):
    rows = [(0, [2.0 ** 21, 1.0], 0), (1, [2.0 ** 21, 2.0 ** -8], 0), (2, [2.0 ** 21, 0.0], 1), (3, [2.0 ** 21 - 2.0 ** -8, 0.5], 1)]  # scores of 2 ** 58 that differ by a little
    assert mined(spark.createDataFrame(rows, VECTORS)) == plain_negatives(rows)


def test_boxes_are_pruned_and_bound_their_rows():
    rng = np.random.default_rng(2)
    centres = rng.integers(-400, 400, (40, 8))
    v = (centres[rng.integers(0, 40, 4000)] + rng.integers(-8, 8, (4000, 8))).astype(np.int64)
    tree = hard_negatives.Tree.from_bytes(hard_negatives.Tree.pack(np.arange(4000), np.arange(4000) % 3, v).to_bytes())
    assert sorted(tree.ids.tolist()) == list(range(4000)) and len(tree.least[-1]) == 1
    for level, (least, most) in enumerate(zip(tree.least, tree.most)):
        width = hard_negatives.LEAF * hard_negatives.FANOUT ** level
        for i in range(len(least)):
            assert (tree.v[width * i:width * (i + 1)] >= least[i]).all() and (tree.v[width * i:width * (i + 1)] <= most[i]).all()
    a = centres[:1].astype(np.int64)
    windows = hard_negatives.Windows.make([0], [-math.inf], [math.inf], True, 5)
    opened = hard_negatives.search(tree, np.array([-1]), np.array([0]), a, windows)
    scores = tree.v @ a[0]
    best = sorted((-s, i) for s, i, label in zip(scores.tolist(), tree.ids.tolist(), tree.labels.tolist()) if label == 0)[:5]
    assert windows.scores[0] == best
    assert opened < 0.5 * sum(map(len, tree.least))


# ---- packing -----------------------------------------------------------------------------------------------------

def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, used):
        if len(used) >= best[0]:
            return
        if i == len(items):
            best[0] = len(used)
            return
        for room in {u for u in used if u + items[i] <= capacity}:
            at = used.index(room)
            go(i + 1, [*used[:at], room + items[i], *used[at + 1:]])
        go(i + 1, [*used, items[i]])

    go(0, [])
    return best[0]


def counts_of(items):
    return {x: items.count(x) for x in set(items)}


def contents(groups):
    out = {}
    for g in groups:
        for length, per in g.contents:
            out[length] = out.get(length, 0) + per * g.count
    return out


def test_reduction_keeps_an_optimum():
    rng = random.Random(2)
    fixed_in_all = 0
    for _ in range(400):
        capacity = rng.choice([10, 20, 30, 50])
        items = [rng.randint(rng.choice([1, capacity // 4]), capacity) for _ in range(rng.randint(1, 9))]
        fixed, rest = packing.reduce_instance(counts_of(items), capacity)
        n = sum(g.count for g in fixed)
        fixed_in_all += n
        left = [x for x, k in rest.items() for _ in range(k)]
        assert n + fewest(left, capacity) == fewest(items, capacity), (items, capacity, fixed)
        groups = packing.pack_histogram(counts_of(items), capacity)
        assert contents(groups) == counts_of(items) and all(sum(x * p for x, p in g.contents) <= capacity for g in groups)
    assert fixed_in_all > 500


def test_grouped_best_fit_equals_piece_by_piece():
    rng = random.Random(3)
    for _ in range(100):
        capacity, items = rng.choice([30, 100]), [rng.randint(1, 30) for _ in range(rng.randint(1, 200))]
        rooms = []
        for length in sorted(items, reverse=True):
            fit = [i for i, room in enumerate(rooms) if room >= length]
            if fit:
                rooms[min(fit, key=rooms.__getitem__)] -= length
            else:
                rooms.append(capacity - length)
        got = [capacity - sum(x * p for x, p in g.contents) for g in packing.best_fit(counts_of(items), capacity) for _ in range(g.count)]
        assert sorted(got) == sorted(rooms)


def test_large_counts_take_few_groups():
    rng = random.Random(5)
    groups = packing.pack_histogram({n: rng.randrange(10 ** 9) for n in range(1, 2049)})
    assert len(groups) < 20_000
    packed = sum(g.count for g in groups)
    assert packed <= -(-sum(n * c for n, c in contents(groups).items()) // 2048) * 1.01


def check_packed(rows, packed, capacity):
    """The pieces of the rows' documents as the library encodes them, each once, in sequences without gaps."""
    tokenizer, want = Tokenizer.from_file(WORD_BPE), []
    for d, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at:at + capacity]
            want.append((d, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=str) == sorted(want, key=str)
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(n <= capacity for n in ends.values()) and sorted(ends) == list(range(len(ends)))
    return len(ends), -(-sum(w[3] for w in want) // capacity)


def test_packing_query_equals_the_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    used, least = check_packed(rows, QUERIES["op13_packing"](spark, SF0001).collect(), 2048)
    assert used <= least + 1


def test_packing_odd_rows_and_sequences(spark):
    rows = [*ODD, (7, "don't <|endoftext|> x<|endoftext|>y 1234  ΣΑΣ É é \xa0a\x1cb\x0bc İx ŉ", "en", "s", 1), *[(100 + i, "a few words here") for i in range(40)], (8, "a few words here")]
    frame = docs(spark, rows, extra=True)
    for c in ("part", "length", "offset", "ids", "number"):
        frame = frame.withColumn(c, F.lit("x"))
    packed = packing.pack(frame.repartition(5), WORD_BPE, capacity=64, with_ids=True)
    got = packed.collect()
    check_packed(rows, got, 64)
    joined = {r.sequence_id: list(r.ids) for r in packing.sequences(packed).collect()}
    for r in got:
        assert joined[r.sequence_id][r.offset:r.offset + r.length] == list(r.ids)
    assert packing.pack(docs(spark, []), WORD_BPE).collect() == []


def test_other_tokenizers_are_encoded_whole():
    words = packing.Words(public_tokenizers.path("byte_bpe_50k.json"))
    text = "two  spaces and\na line feed, Ünicode"
    assert not words.by_word
    assert words.encode(text) == np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

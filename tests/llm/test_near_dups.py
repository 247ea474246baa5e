import random

import pytest
import xxhash

from supplyscope.llm import line_dedup, simhash
from supplyscope.llm.components import components
from supplyscope.llm.queries import QUERIES
from tests.conftest import SF0001
from tests.llm.helpers import ODD, docs, prose


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["random", "path", "star"])
def test_components_equal_union_find(spark, shape):
    rng = random.Random(3)
    pairs = {"random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)], "path": [(i, i + 1) for i in range(40)],
             "star": [(0, i) for i in range(1, 400)]}[shape]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == {n: r for n, r in roots(linked, pairs).items()}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    fps = {d: plain_fingerprint(t) for d, t in rows}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    want = roots(fps, links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op8_simhash"](spark, SF0001).collect()}
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in fps}
    assert len(set(want.values())) < len(fps)


def test_large_buckets_link_like_small_ones(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(3)]
    fps = sorted({b ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(4))) for b in base for _ in range(60)})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = roots(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    for limit in (3, 1000):  # through centres, and pair by pair
        got = roots(fps, [tuple(r) for r in simhash.link_fingerprints(frame, bucket_pairs=limit).collect()])
        assert got == want


def test_simhash_odd_rows(spark):
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_components(docs(spark, ODD, extra=True)).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (None, None), (5, 5), (6, 6)], key=str)
    kept = simhash.keep_one(docs(spark, ODD, extra=True))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, None, 5, 6], key=str)
    assert "keep_id" in kept.columns and len(kept.columns) == len(docs(spark, ODD, extra=True).columns)
    assert simhash.simhash_components(docs(spark, [])).collect() == []


def plain_classes(rows):
    sets, order = {}, []
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\n\v\f\r"):
                low = line.lower()
                sets.setdefault(line, {low[i:i + 8] for i in range(max(1, len(low) - 7))})
                order.append((d, k, line))
    names = list(sets)
    links = [(a, b) for i, a in enumerate(names) for b in names[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root, seen, gone = roots(names, links), set(), set()
    for d, k, line in order:
        if root[line] in seen:
            gone.add((d, k))
        seen.add(root[line])
    return gone


def line_fixture():
    rng = random.Random(8)
    base = [prose(rng, rng.randrange(4, 40)) for _ in range(30)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(base) if rng.random() < 0.4 else prose(rng, rng.randrange(3, 30))
            if rng.random() < 0.3:  # a small edit
                at = rng.randrange(len(line))
                line = line[:at] + "q" + line[at + 1:]
            lines.append(rng.choice(["", line, line.upper(), line]))
        rows.append((d, "\n".join(lines)))
    return rows


def test_line_dedup_moves_asked_lines_alone_and_sets_never(spark, monkeypatch):
    texts = ["ab", "ABABABABABABAB", "é" * 30, *(f"line {i} of {i * i} lines" for i in range(300))]
    lines = spark.createDataFrame([(i * 7919 - 900_000, t) for i, t in enumerate(texts)] * 2, "line_id long, line string")
    want = {i * 7919 - 900_000: t for i, t in enumerate(texts) if i % 5 < 2}
    asked = spark.createDataFrame([(i,) for i in [*want, 12345]], "id long")
    for bits in (1 << 15, 1 << 26):
        monkeypatch.setattr(line_dedup, "FILTER_BITS", bits)
        own = line_dedup.asked_lines(lines, asked)
        assert sorted(map(tuple, own.collect())) == sorted(want.items())
    sets, name = line_dedup.stored_by_line(line_dedup.shingle_sets(own))
    plain = {i: len({t.lower()[k:k + 8] for k in range(max(1, len(t) - 7))}) for i, t in want.items()}
    assert {r.line_id: r.n for r in sets.collect()} == plain == {r.line_id: len(set(r.s)) for r in sets.collect()}
    monkeypatch.setattr(line_dedup, "SIMILARITY", 0.5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        ids = sorted(want)
        near = line_dedup._verified(spark.createDataFrame([(a, b) for a in ids for b in ids if a < b], "a long, b long"), sets)
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 3  # pairs alone: by b, by a and by b again
        cut = {i: {t.lower()[k:k + 8] for k in range(max(1, len(t) - 7))} for i, t in want.items()}
        assert {(r.a, r.b) for r in near.collect()} == {(a, b) for a in ids for b in ids if a < b and 2 * len(cut[a] & cut[b]) >= len(cut[a] | cut[b])}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def gone_lines(spark, rows):
    return {(r.doc_id, r.line_no) for r in line_dedup.line_classes(docs(spark, rows)).where("NOT kept").collect()}


def test_line_dedup_equals_brute_force(spark):
    rows = line_fixture()
    want = plain_classes(rows)
    assert len(want) > 20
    assert gone_lines(spark, rows) == want


def test_hot_line_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BUCKET_PAIRS", 3)
    rng = random.Random(9)
    base = prose(rng, 40)
    rows = [(i, base[:200] + f"{i:02d}" + base[200:]) for i in range(25)] + [(100 + i, prose(rng, 30)) for i in range(10)]
    assert gone_lines(spark, rows) == {(i, 0) for i in range(1, 25)}


def letters(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


@pytest.mark.parametrize("template, own", [(80, 40), (110, 45), (60, 50), (110, 16)])
def test_pairs_behind_one_template(spark, template, own):
    """Pairs of lines with one character changed, all behind the same text: every pair is linked, and with the last shape no two pairs are similar."""
    rng = random.Random(template)
    shared, rows = letters(rng, template), []
    for i in range(400):
        line = shared + letters(rng, own)
        at = template + own - 1 - rng.randrange(3)
        rows += [(2 * i, line), (2 * i + 1, line[:at] + ("#" if line[at] != "#" else "+") + line[at + 1:])]
    want = plain_classes(rows)
    assert len(want) >= 400
    assert gone_lines(spark, rows) == want


def test_many_variants_of_one_line(spark, monkeypatch):
    """Edits all over a line: each variant has frequent shingles of its own choice, so the shingles are crowded and central pivots are used."""
    monkeypatch.setattr(line_dedup, "BUCKET_PAIRS", 8)
    rng = random.Random(12)
    base, rows = letters(rng, 160), []
    for i in range(300):
        line = list(base)
        for at in rng.sample(range(160), rng.choice([1, 2, 3])):
            line[at] = rng.choice("ABCDEF0123")
        rows.append((i, "".join(line)))
    want = plain_classes(rows)
    assert len(want) > 150
    assert gone_lines(spark, rows) == want


def test_dedup_lines_odd_rows(spark):
    rows = [*ODD, (7, "same text\nother", "en", "s", 1)]
    frame = docs(spark, rows, extra=True)
    out = line_dedup.dedup_lines(frame)
    assert out.columns == frame.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(d, "other" if d == 7 else t) for d, t, *_ in rows], key=str)
    assert line_dedup.line_classes(docs(spark, [])).collect() == []


def test_two_forms_of_a_line_with_one_link(spark, monkeypatch):
    """Two forms of a line, each among many variants that are similar to it: only the two forms link them."""
    monkeypatch.setattr(line_dedup, "BUCKET_PAIRS", 4)
    rng = random.Random(5)
    base = letters(rng, 400)
    a, b = (base[:at] + "".join(rng.choice("#+*=") for _ in range(13)) + base[at + 13:] for at in (40, 340))
    rows = list(enumerate([a, b] + [a[:-k] for k in range(7, 21)] + [b[k:] for k in range(7, 21)]))
    want = plain_classes(rows)
    assert want == {(i, 0) for i in range(1, 30)} and plain_classes(rows[1:]) == {(i, 0) for i in range(2, 30) if i != 2}
    assert gone_lines(spark, rows) == want

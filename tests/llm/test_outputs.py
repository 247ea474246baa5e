import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from supplyscope.llm import files, mixing, substring_dedup, token_store, warc
from supplyscope.llm.common import materialize
from supplyscope.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF0001
from tests.llm.helpers import ODD, docs, prose
from tests.oracle_compare import compare, duck

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PAGES = "page_id long, url string, html string"


def test_warc_query_equals_sql(spark):
    assert compare(QUERIES["op6_warc"](spark, SF0001), duck(SF0001), ORACLE_SQL["op6_warc"])["ok"]


@pytest.mark.parametrize("split", [700, 1 << 20])
def test_warc_round_trip(spark, split):
    rng = random.Random(3)
    rows = [(i, f"http://a/{i} b\n", "".join(map(chr, rng.choices(range(1, 500), k=rng.randrange(0, 900))))) for i in range(40)]
    rows += [(50, None, None), (51, "u", ""), (52, "u", "y" * 100), (53, "u", "y" * 100), (54, "u", "z" * 99), (55, "u", "z" * 99), (53, "u", "y" * 100)]
    wrote = warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(3), max_bytes=4000)
    got = warc.read_warc(wrote, split_bytes=split, with_payload=True).collect()
    assert len(got) == len(rows)
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(html[r.page_id]), hashlib.sha256(html[r.page_id]).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 52) if r.page_id == 53 else ("response", None))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html[r.page_id]
    assert warc.read_warc(warc.write_warc(spark.createDataFrame([], PAGES))).collect() == []


def test_ranges_are_read_by_a_task_each(spark):
    """Adaptive execution doesn't merge the ranges, though their rows are tiny; other columns may have any name."""
    frame = spark.createDataFrame([(i, f"http://a/{i}", prose(random.Random(i), 300)) for i in range(60)], PAGES)
    for c in ("payload", "digest", "n", "start", "path", "first_id"):
        frame = frame.selectExpr("*", f"'x' AS {c}")
    wrote = warc.write_warc(frame)
    read = warc.read_warc(wrote, split_bytes=4000)
    ranges = sum(-(-r.n_bytes // 4000) for r in wrote.collect())
    assert ranges >= 8 and read.rdd.getNumPartitions() == ranges
    assert read.count() == 60


def test_long_headers_are_read(spark):
    rng = random.Random(13)
    urls = {1: "data:" + "".join(rng.choices("abcdefgh0123456789", k=200_000)), 2: "data:" + " \n" * 100_000, 3: "data:" + "x" * 65_300, 4: "u", 5: "data:" + "y" * 3_000_000}
    wrote = warc.write_warc(spark.createDataFrame([(i, u, f"page {i}") for i, u in urls.items()], PAGES).coalesce(1))
    got = {r.page_id: r.target_uri for r in warc.read_warc(wrote, split_bytes=5000).collect()}
    assert got == {i: warc._plain_uri(u) for i, u in urls.items()}


def test_headers_end_at_any_piece():
    record = warc.warc_record(7, "data:" + "z" * 3000, b"payload", "00", None, "d")
    data = warc._member(record, 0) + warc._member(b"WARC/1.1\r\nno header\r\n\r\n", 0) + warc._member(b"WARC/1.1\r\nA: b\r\n", 0)

    class Bytes:  # a byte at a time
        size = len(data)

        def get(self, pos, n):
            return data[pos:pos + 1]

    window = Bytes()
    assert warc._inflate(window, 0) == (record, len(warc._member(record, 0)))
    assert warc._inflate(window, len(warc._member(record, 0))) is None
    assert warc._inflate(window, len(data) - len(warc._member(b"WARC/1.1\r\nA: b\r\n", 0))) is None


def test_false_magics_are_skipped():
    record = warc.warc_record(1, "u", b"payload \x1f\x8b\x08 inside", "00", None, "d")
    data = b"\x1f\x8b\x08junk" + warc._member(record, 0) + warc._member(b"\x1f\x8b\x08" * 9, 0) + warc._member(b"no record", 6) + warc._member(record, 6)

    class Handle:
        def read_at(self, n, pos):
            return data[pos:pos + n]

    found = list(warc.records_in(warc._Window(Handle(), len(data)), 0, len(data)))
    assert [h["x-page-id"] for _, _, h, _ in found] == ["1", "1"]


TEXTS = ["", " ", "\n", "a\n", "\na", " a", "a ", "a  b", "a \nb", "don't stop<|endoftext|> x", "x\t y\n\n z", "日本 語 1234 a1", "é.\nÉa", "a. b!? c...", " x  y", "ab,cd e.f"]


def test_encoder_equals_the_library():
    enc, plain = token_store.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choices("ab é.\n\t,!1ß' ", k=rng.randrange(1, 60))) for _ in range(400)]
    for t in texts:
        want = np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes()
        assert enc.encode(t) == want, repr(t)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-2**62, 2**62, 20_000))
    table = token_store.PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))  # minimal: every slot once
    index = token_store.BucketIndex(token_store.pack_index(keys, [keys * 3]))
    found, (values,) = index.get(keys)
    assert found.all() and (values == keys * 3).all()
    assert not index.get(keys + 1)[0][~np.isin(keys + 1, keys)].any()
    assert not token_store.BucketIndex(token_store.pack_index(np.zeros(0, np.int64), [np.zeros(0, np.int64)])).get(keys)[0].any()


def test_token_query_equals_the_library(spark):
    plain = Tokenizer.from_file(VOCABULARY)
    want, at = {}, 0
    for r in sorted(spark.read.parquet(f"{SF0001}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want[r.doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_token_store"](spark, SF0001).collect()} == want


def test_token_store_odd_rows(spark):
    plain = Tokenizer.from_file(VOCABULARY)
    frame = docs(spark, ODD, extra=True)
    store = token_store.write_tokens(frame, VOCABULARY, shards=3)
    got = store.read_all(frame.select("doc_id"), with_ids=True).orderBy("start").collect()
    texts = [t or "" for d, t, *_ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))]
    assert [list(r.ids) for r in got] == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    keys = spark.createDataFrame([(4,), (12345,), (None,)], "doc_id long")
    assert [(r.doc_id, r.n_docs) for r in store.lookup(keys).collect()] == [(4, 2)]
    fs, path = files.open_fs(store.uri)
    assert sum(f.size for f in fs.get_file_info([f"{path}/shard-{i:06d}.bin" for i in range(3)])) == 2 * sum(r.n_tokens for r in got)
    none = token_store.write_tokens(docs(spark, []), VOCABULARY, shards=2)
    assert none.read_all(keys).collect() == []


def plain_repeats(rows, least):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = {}
    for _, b in data:
        for i in range(len(b) - least + 1):
            seen[b[i:i + least]] = seen.get(b[i:i + least], 0) + 1
    out = []
    for d, b in data:
        gone = set()
        for i in range(len(b) - least + 1):
            if seen[b[i:i + least]] > 1:
                gone.update(range(i, i + least))
        kept = bytes(x for i, x in enumerate(b) if i not in gone)
        out.append((d, len(b), len(gone), sum(i in gone and i - 1 not in gone for i in range(len(b))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("many", [1, 1024])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(substring_dedup, "MANY", many)  # 1: windows of names with several contexts are counted; else expanded
    monkeypatch.setattr(substring_dedup, "LONGEST_RUN", 50)
    rng = random.Random(5)
    shared = [prose(rng, 30) for _ in range(4)]
    rows = []
    for d in range(30):
        parts = [prose(rng, rng.randrange(5, 40)) for _ in range(3)]
        if d % 2:
            s = rng.choice(shared)
            parts.insert(1, s[rng.randrange(20):len(s) - rng.randrange(20)])
        rows.append((d, "é ".join(parts)))
    rows += [(90, "ab" * 200), (91, "x" * 300), (92, rows[3][1]), (93, rows[3][1]), (None, rows[5][1]), (94, None), (95, ""), (96, "short")]
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(docs(spark, rows, extra=True), least=80).collect()), key=str)
    assert got == plain_repeats(rows, 80)


def test_expansion_equals_counting():
    rng = random.Random(1)
    for trial in range(25):
        ab = rng.choice([b"ab", b"abcde"])
        contexts = list({bytes(rng.choices(ab, k=rng.randrange(12, 60))) for _ in range(rng.randrange(1, 8))})
        copies = np.array([rng.choice([1.0, 1.0, 2.0]) for _ in contexts])
        seen = {}
        for c, n in zip(contexts, copies):
            for i in range(len(c) - 11):
                seen[c[i:i + 12]] = seen.get(c[i:i + 12], 0) + n
        for c, hit in zip(contexts, substring_dedup.repeated_windows(contexts, copies, 12)):
            assert hit.tolist() == [seen[c[i:i + 12]] >= 2 for i in range(len(c) - 11)]


def test_substring_dedup_of_nothing(spark):
    """And no table stays behind."""
    assert substring_dedup.remove_repeats(docs(spark, [])).collect() == []
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("llm_")]


def test_mixing_meets_the_marginals(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(5, 60)), rng.choice(["en", "en", "de"]), rng.choice(["a", "a", "a", "b", None]), 0) for i in range(300)]
    targets = {"source": {"a": 0.4, "b": 0.4}, "lang": {"en": 0.5, "de": 0.5}}
    got = mixing.mix(docs(spark, rows), targets).collect()
    total = sum(r.n_tokens * r.probability for r in got)
    share = lambda c, v: sum(r.n_tokens * r.probability for r in got if r[c] == v) / total
    for c, v, want in (("source", "a", 0.4), ("source", "b", 0.4), ("source", None, 0.2), ("lang", "en", 0.5), ("lang", "de", 0.5)):
        assert share(c, v) == pytest.approx(want, abs=1e-4)
    assert max(r.probability for r in got) == pytest.approx(1)
    assert all(r.kept == (r.uniform < r.probability) for r in got) and all(r.kept for r in got if r.probability == 1)


def test_mixing_odd_rows(spark):
    frame = docs(spark, ODD, extra=True)
    got = mixing.mix(frame).collect()
    assert len(got) == len(ODD) and all(0 <= r.probability <= 1 for r in got)
    out = mixing.sample_mixture(frame)
    assert out.columns == frame.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted((r.doc_id for r in got if r.kept), key=str)
    assert mixing.mix(docs(spark, [])).collect() == []


def test_pipeline_stages_follow_each_other(spark):
    frame = spark.read.parquet(f"{SF0001}/documents.parquet")
    columns, now = frame.columns, frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in now.select("doc_id").collect()}
        now = materialize(stage(spark, now, SF0001), "test")
        assert now.columns == columns and {r.doc_id for r in now.collect()} <= before, name
    plain, want, at = Tokenizer.from_file(VOCABULARY), {}, 0
    for r in sorted(now.collect(), key=lambda r: r.doc_id):
        ids = np.array([*plain.encode(r.text, add_special_tokens=False).ids, 2], dtype="<u4")
        want[r.doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, SF0001).collect()} == want

"""Filter interaction audit: what each quality filter removes alone, after others, and on average over all orders.

Five filters fail a document: A few words, B few distinct words, C many capitals, D a symbol, E a copy of a document with a smaller doc_id.

* A to D are decided inside the row.  For E an existential self-join marks copies: a left-semi join on the text's hash, the exact text and a smaller doc_id.
  Its right side holds each text that may repeat once, with its smallest doc_id, which is the witness for all others; its left side holds only rows whose hash
  occurs twice, and adaptive execution splits a text that very many rows share, since the left side of a semi join may be split.
* The marked ids are united with the ids of the other failures, and each document's bits are added by one aggregate of (doc_id, hash of the text).
* Documents are then counted by part (language) and combination of bits, at most 32 rows a part.  All orders are worked out from these counts: a filter at its
  step removes the combinations that hold its bit and none of the bits before it.  No order reads a document again.

Defined cases: null and empty texts have no words, so they fail A (0 < 200) and not B (0 < 0 is false), and empty texts are copies of each other; a null language
is the part "" like an empty one; a document without a doc_id is no copy and no witness; repeated rows count each, and since their doc_ids are equal none is the other's copy;
several labels of one document count once if any says so, labels without a document count nowhere; very long texts are read whole; an empty table gives no rows.
Only doc_id, text and lang are read (doc_id, quality and toxic of the labels), so other columns may have any name.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyscope.llm.common import discard, materialize, text_of

SPACE = "[\\x20\\x09-\\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, "[#$%&*|]"
FILTERS = "ABCDE"  # bit i is the i-th letter's
COPY = FILTERS.index("E")


def row_failures(words: str, text: str) -> list[Column]:
    """The failure conditions A to D, over a column of words and one of the whole text."""
    n = F.size(words)
    return [n < LEAST_WORDS,
            F.size(F.array_distinct(words)) * 100 < n * LEAST_DISTINCT,
            F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * MOST_CAPITALS,
            F.col(text).rlike(SYMBOLS)]


def failing_rows(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, part, h, bits), one for each row of ``docs``, with the bits of the filters A to D."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_of().alias("t"))
    cut = base.withColumns({"h": F.xxhash64("t"), "w": F.filter(F.split("t", SPACE), lambda x: x != "")})
    bits = [F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(row_failures("w", "t"))]
    total = bits[0]
    for bit in bits[1:]:
        total = total + bit
    return cut.select("doc_id", "part", "h", total.cast("int").alias("bits"))


def copies(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows (doc_id, part, h) of documents whose text a smaller doc_id has too.  ``rows``: ``failing_rows`` of the same documents."""
    twice = rows.where("doc_id IS NOT NULL").groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select(F.col("h").alias("k"))
    # repeated hashes grow with the documents, so they are never broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_of().alias("t"))
    held = materialize(texts.where("doc_id IS NOT NULL").withColumn("h", F.xxhash64("t")).join(twice.hint("merge"), F.col("h") == F.col("k"), "left_semi"), "copies")
    first = held.groupBy("h", "t").agg(F.min("doc_id").alias("first_id")).select(F.col("h").alias("first_h"), F.col("t").alias("first_t"), "first_id")
    same = (F.col("h") == F.col("first_h")) & (F.col("t") == F.col("first_t")) & (F.col("first_id") < F.col("doc_id"))
    marked = materialize(held.join(first, same, "left_semi").select("doc_id", "part", "h"), "marked", narrow=True)
    discard(held)
    return marked


def failure_bits(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, part, bits, n): the failures of each document as bits in the order of ``FILTERS``, and its number of rows."""
    rows = materialize(failing_rows(docs), "failures")
    marks = copies(docs, rows)
    united = rows.withColumn("n", F.lit(1)).unionByName(marks.select("*", F.lit(1 << COPY).alias("bits"), F.lit(0).alias("n")))
    return united.groupBy("doc_id", "part", "h").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n")).select("doc_id", "part", "bits", "n")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, bits, n, good, toxic): documents of each part and combination of failures, and those labelled good or toxic."""
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    bits = failure_bits(docs)
    joined = bits.join(marked, F.col("doc_id") == F.col("label_id"), "left")
    of = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return joined.groupBy("part", "bits").agg(of("good"), of("toxic"), F.sum("n").alias("n")).select("part", "bits", "n", "good", "toxic")


def order_report(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row a part, order of the filters and step, from rows (part, bits, n, good, toxic)."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    steps = [(("".join(order)), k + 1, bit[f], sum(bit[g] for g in order[:k])) for order in permutations(filters) for k, f in enumerate(order)]
    orders = len(steps) // len(filters)
    plan = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(b).alias("own"), F.lit(p).alias("before")) for o, k, b, p in steps])
    held = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("c"))  # at most 2 ** len(filters) a part
    rows = held.select("part", "c", F.explode(plan).alias("s")).select("part", "c", "s.*")

    def total(keep, value=lambda x: x["n"]) -> Column:
        return F.aggregate(F.filter("c", keep), F.lit(0).cast("long"), lambda a, x: a + value(x).cast("long"))

    own = lambda x: x["bits"].bitwiseAND(F.col("own")) != 0
    early = lambda x: x["bits"].bitwiseAND(F.col("before")) != 0
    removed = lambda x: own(x) & ~early(x)
    # of the orders, a filter comes first among the f failures of a document in one of f: then it is the one that removes it
    share = lambda x: x["n"] * F.lit(orders) / F.bit_count(x["bits"])
    return rows.select("part", "filter_order", "step",
                       total(lambda x: ~own(x) & ~early(x)).alias("kept"), total(removed).alias("removed"), total(lambda x: own(x) & early(x)).alias("redundant"),
                       total(lambda x: x["bits"] == F.col("own")).alias("unique_fails"), total(removed, lambda x: x["good"]).alias("good_lost"),
                       total(removed, lambda x: x["toxic"]).alias("toxic_lost"), total(own, share).alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step.

    kept: documents left after the step; removed: at it; redundant: failing its filter but removed before; unique_fails: failing only its filter;
    good_lost and toxic_lost: labelled documents removed at it; shapley: what its filter removes, added over all orders.
    """
    return order_report(materialize(combinations(docs, labels), "combinations", narrow=True))

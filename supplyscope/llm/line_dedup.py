"""Fuzzy line dedup by MinHash, with DataFrame and SQL functions alone.

Lines (parts of a text between line feeds) with a similarity of ``SIMILARITY`` or more, the Jaccard similarity of their sets of
``SHINGLE``-character shingles in lower case, are linked; of each connected component one line stays, the first by doc_id and place.

* Signature: the lines' shingles, fixed-width slices of the line in UTF-16, are hashed and dealt to ``BINS`` bins by their remainder; the smallest hash of each
  bin is kept (MinHash by one permutation).  Slices are exploded and aggregated, so all of this is compiled code.
* Banding: ``ROWS`` bins make a band, and a band's key is the hash of their minima.  Two lines of similarity 0.8 agree on a band with a probability
  of 0.51 and miss all eight of them in 3 of 1,000 cases, those of 0.85 in 5 of 10,000.  A band whose bins are all empty gives no key.
* Candidates: lines that share a key.  Buckets of up to ``BUCKET_PAIRS`` distinct lines give all their pairs whose signatures agree, by four bits a bin, in ``LEAST_MARKED`` of ``MARKED``
  bins, as all but 1 of 1,000 pairs of similarity 0.8 do.
* Larger buckets: first the lines of a bucket are compared with a few centres of it, one line of each of its largest components so far, in rounds of 1, 4, 16 and 64 centres.  What is similar
  joins their components, so a group of variants of one line is connected by as many pairs as it has lines.  Buckets with at most ``BUCKET_PAIRS`` lines outside their largest component take no
  further round.  Then each line outside it meets all lines of the bucket's other components whose signatures agree as above.  So every pair of a bucket is either in one component or compared,
  as in small buckets: no link is lost here.  Signatures are compared within the join; only pairs that agree become rows.
* Verification: the exact Jaccard similarity of each candidate pair, from shingle sets that are stored once for each line concerned, in buckets of line_id, so joins move pairs alone.
  Then connected components.

Lines that are equal as they are have one id (a 64-bit hash of the line), so copies are counted once in all of this.  Texts of lines are moved only for lines that are candidates
(a bitmap of their ids, of bounded size, comes before the exact join).

Defined cases: blank lines are kept and never compared; null and empty texts have no lines to compare; a line shorter than a shingle is one shingle; a very
long line is compared whole; rows that repeat doc_id and text are one document and keep the same lines; documents without a doc_id come last in the
order; an empty table gives no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplyscope.llm.common import discard, fresh_dir, materialize, text_of
from supplyscope.llm.components import components

SHINGLE, SIMILARITY = 8, 0.8
BINS, ROWS = 24, 3  # bins of a signature, and of a band
MARKED, LEAST_MARKED = 16, 8
BUCKET_PAIRS = 48
CENTRE_ROUNDS = 4
A_ROW = 8  # shingles that are hashed, binned and added to the minima as one row
FILTER_BITS = 1 << 26  # of the filter before texts of lines are moved


def units(line: str) -> Column:
    """A line in lower case and UTF-16, two bytes a character (or half of a rare one)."""
    return F.encode(F.lower(F.col(line)), "UTF-16BE")


def short_hash(shingle: Column) -> Column:
    """32 bits of a shingle's hash: half the bytes to move.  Of two lines with 1,000 shingles each one in 4,000 pairs of lines has a common hash too many."""
    return F.shiftright(F.xxhash64(shingle), 32).cast("int")


def shingle_rows(lines: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Rows (line_id, h0, h1, …) of ``A_ROW`` places of shingles each, from rows (line_id, line).  The last row of a line repeats its last place, which no minimum minds."""
    cut = lines.select("line_id", units("line").alias("u")).withColumn("last", F.greatest(F.octet_length("u") - (2 * k - 1), F.lit(1)))
    rows = cut.select("line_id", "u", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(2 * A_ROW))).alias("i"))
    return rows.select("line_id", *[short_hash(F.substring("u", F.least(F.col("i") + 2 * d, F.col("last")), F.lit(2 * k))).alias(f"h{d}") for d in range(A_ROW)])


def shingle_sets(lines: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Rows (line_id, s, n): the distinct shingles of each line and their number, from distinct rows (line_id, line)."""
    held = shingle_rows(lines, k).groupBy("line_id").agg(F.collect_list(F.array(*[f"h{d}" for d in range(A_ROW)])).alias("l"))
    return held.select("line_id", F.array_distinct(F.flatten("l")).alias("s")).select("line_id", "s", F.size("s").alias("n"))


def line_rows(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, line_no, line, line_id) for every line with a character other than white space."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    lines = base.select("doc_id", F.xxhash64("t").alias("text_hash"), F.posexplode(F.split("t", "\n")).alias("line_no", "line"))
    return lines.where(F.btrim("line", F.lit(" \t\n\u000b\f\r")) != "").withColumn("line_id", F.xxhash64("line"))


def signatures(lines: DataFrame) -> DataFrame:
    """Rows (line_id, keys, mark) from rows (line_id, line): the key of each band, null where its bins are empty, and four bits of each of the first 16 bins."""
    binned = shingle_rows(lines).withColumns({f"bin{d}": F.pmod(f"h{d}", F.lit(BINS)) for d in range(A_ROW)})
    least = binned.groupBy("line_id").agg(*[F.min(F.least(*[F.when(F.col(f"bin{d}") == j, F.col(f"h{d}")) for d in range(A_ROW)])).alias(f"m{j}") for j in range(BINS)])
    least_of = [[f"m{i}" for i in range(j, j + ROWS)] for j in range(0, BINS, ROWS)]
    bands = [F.when(F.coalesce(*own).isNotNull(), F.xxhash64(F.lit(j), *own)) for j, own in enumerate(least_of)]
    mark = F.lit(0).cast("long")
    for j in range(MARKED):  # bits above those that chose the bin; an empty bin is 0
        bits = F.coalesce(F.shiftrightunsigned(f"m{j}", 20).bitwiseAND(F.lit(15)), F.lit(0)).cast("long")
        mark = mark.bitwiseOR(F.shiftleft(bits, 4 * j))
    return least.select("line_id", F.array(*bands).alias("keys"), mark.alias("mark"))


def marks_agree(a: Column, b: Column) -> Column:
    """The number of marked bins in which two signatures agree (one of 16 others agrees by chance)."""
    x = a.bitwiseXOR(b)
    spread = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
    return F.lit(MARKED) - F.bit_count(spread.bitwiseAND(F.lit(0x1111111111111111)))


def stored_by_line(sets: DataFrame) -> tuple[DataFrame, str]:
    """``sets`` stored in buckets of line_id, so joins on it do not move them again, and the table's name."""
    spark = sets.sparkSession
    path = fresh_dir(spark, "shingle-sets")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets.write.bucketBy(buckets, "line_id").sortBy("line_id").option("path", path).saveAsTable(name)
    return spark.table(name), name


def _all_pairs(members: DataFrame) -> DataFrame:
    """Pairs a < b of the lines of each bucket of up to ``BUCKET_PAIRS`` of them whose signatures agree in ``LEAST_MARKED`` marked bins."""
    held = members.groupBy("key").agg(F.collect_list(F.struct("line_id", "mark")).alias("l"))
    return (held.select("l", F.explode("l").alias("x"))
            .select(F.col("x.line_id").alias("a"), F.explode(F.filter("l", lambda y: (y["line_id"] > F.col("x.line_id")) & (marks_agree(y["mark"], F.col("x.mark")) >= LEAST_MARKED))).alias("y"))
            .select("a", F.col("y.line_id").alias("b")).distinct())


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (and their other columns) whose exact similarity is high enough."""
    size = sets.select(F.col("line_id").alias("b"), F.col("n").alias("n_b"))
    one = sets.select(F.col("line_id").alias("a"), F.col("n").alias("n_a"), F.col("s").alias("s_a"))
    other = sets.select(F.col("line_id").alias("b"), F.col("s").alias("s_b"))
    # lengths first, so only pairs that can be similar carry a set; ``sets`` is stored by line_id, so it is not moved itself
    fit = pairs.where(F.col("a") != F.col("b")).join(size, "b").join(one, "a").where(F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b"))
    both = F.size(F.array_intersect("s_a", "s_b"))  # at least this many of similar sets; written once, as it is worked out wherever it stands
    least = F.ceil((F.col("n_a") + F.col("n_b")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6)
    return fit.join(other, "b").where(both >= least).select(*pairs.columns)


def _named(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """``members`` with the root of each line's component; without a link a line is its own root."""
    if links is None:
        return members.withColumn("root", F.col("line_id"))
    roots = components(links).withColumnRenamed("node", "line_id")
    return members.join(roots, "line_id", "left").withColumn("root", F.coalesce("root", "line_id"))


def _parts(named: DataFrame, deal: int) -> DataFrame:
    """Rows (key, root, n, c): how many lines of each bucket are in one component, and one of them, another one for each ``deal``."""
    one = F.min_by(F.struct("line_id", "mark"), F.struct(F.xxhash64("line_id", F.lit(deal)), F.col("line_id"))).alias("c")
    return named.groupBy("key", "root").agg(F.count("*").alias("n"), one)


def _main_parts(parts: DataFrame) -> DataFrame:
    """Rows (key, main, others): the largest component of each bucket of several, and how many lines are in the others."""
    largest = F.max(F.struct("n", "root"))
    return parts.groupBy("key").agg(largest.alias("l"), F.sum("n").alias("m")).select("key", F.col("l.root").alias("main"), (F.col("m") - F.col("l.n")).alias("others")).where("others > 0")


def hot_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Similar pairs (a, b) of the crowded buckets' lines, enough to connect all similar lines of a bucket (see the module's text)."""
    links, centres, agree = None, 1, marks_agree(F.col("mark"), F.col("c.mark")) >= LEAST_MARKED
    for deal in range(CENTRE_ROUNDS):
        named = materialize(_named(members, links), "hot-members", narrow=True)
        parts = _parts(named, deal)
        crowded = _main_parts(parts).where(F.col("others") > BUCKET_PAIRS).select("key")
        if crowded.isEmpty():
            break
        rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "root"))
        chosen = parts.join(crowded, "key", "left_semi").withColumn("k", rank).where(F.col("k") <= centres).select("key", F.col("root").alias("c_root"), "c")
        asked = named.join(chosen, "key").where((F.col("root") != F.col("c_root")) & agree)
        asked = asked.select(F.least("line_id", "c.line_id").alias("a"), F.greatest("line_id", "c.line_id").alias("b")).distinct()
        hits = materialize(_verified(asked, sets), "line-links", narrow=True)
        links, centres = hits if links is None else links.unionByName(hits), 4 * centres
    else:
        named = materialize(_named(members, links), "hot-members", narrow=True)
    # every other pair of the signatures: the lines outside a bucket's largest component with all lines of other components
    main = named.join(_main_parts(_parts(named, 0)), "key")
    left = main.where(F.col("root") != F.col("main")).select("key", F.struct("line_id", "mark").alias("c"), F.col("root").alias("c_root"), F.col("main").alias("c_main"))
    met = named.join(left, "key").where((F.col("root") != F.col("c_root")) & ((F.col("root") == F.col("c_main")) | (F.col("line_id") < F.col("c.line_id"))) & agree)
    met = met.select(F.least("line_id", "c.line_id").alias("a"), F.greatest("line_id", "c.line_id").alias("b")).distinct()
    last = materialize(_verified(met, sets), "line-links", narrow=True)
    return last if links is None else links.unionByName(last)


def asked_lines(lines: DataFrame, asked: DataFrame) -> DataFrame:
    """The distinct rows (line_id, line) whose line_id is one of ``asked`` (id).

    A bitmap of ``FILTER_BITS`` at most, one bit an id, keeps most other lines from being moved; the join behind it is exact.
    """
    place = lambda c: F.pmod(F.col(c), F.lit(FILTER_BITS)) + 1
    bits = asked.select(place("id").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    at = F.bitmap_bit_position(place("line_id"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = lines.join(F.broadcast(bits), F.bitmap_bucket_number(place("line_id")) == F.col("bucket"))
    near = near.where(F.getbit(byte, (at % 8).cast("int")) == 1)
    # an inner join, as the ids are distinct: a semi join would be moved below the filter
    return near.select("line_id", "line").join(asked, F.col("line_id") == F.col("id")).select("line_id", "line").dropDuplicates(["line_id"])


def line_links(lines: DataFrame) -> DataFrame:
    """Links (a, b) between similar distinct lines, from rows (line_id, line), which may repeat; enough to connect all similar lines that share a band."""
    keys = signatures(lines).select("line_id", "mark", F.explode("keys").alias("key")).where("key IS NOT NULL")
    counted = keys.withColumn("m", F.count("*").over(Window.partitionBy("key")))
    shared = materialize(counted.where("m > 1"), "line-buckets", narrow=True)  # most keys have one line
    pairs = materialize(_all_pairs(shared.where(F.col("m") <= BUCKET_PAIRS)), "line-pairs", narrow=True)
    hot = shared.where(F.col("m") > BUCKET_PAIRS).select("key", "line_id", "mark")
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(hot.select(F.col("line_id").alias("id"))).distinct(), "asked-lines", narrow=True)
    sets, name = stored_by_line(shingle_sets(asked_lines(lines, asked)))
    links = materialize(_verified(pairs, sets), "line-links", narrow=True)
    if not hot.isEmpty():
        links = links.unionByName(hot_pairs(hot, sets))
    discard(sets)
    lines.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    return links


def line_classes(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, line_no, line_id, class_id, first_doc, kept) for every line that is not blank.

    class_id is the smallest line_id of the component; kept is true for its first line, by doc_id (nulls last), hash of the text and place.
    """
    rows = line_rows(docs)
    roots = components(line_links(rows.select("line_id", "line")))
    seen = materialize(rows.select("doc_id", "text_hash", "line_no", "line_id"), "lines")
    roots = roots.select(F.col("node").alias("line_id"), F.col("root").alias("class_id"))
    named = seen.select("doc_id", "text_hash", "line_no", "line_id").join(roots, "line_id", "left").withColumn("class_id", F.coalesce("class_id", "line_id"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("text_hash"), F.col("line_no"))
    first = named.groupBy("class_id").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    many = first.where("n > 1").select("class_id", F.col("first.doc_id").alias("first_doc"), F.col("first.text_hash").alias("first_hash"), F.col("first.line_no").alias("first_no"))
    kept = F.col("first_no").isNull() | (F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("text_hash") == F.col("first_hash")) & (F.col("line_no") == F.col("first_no")))
    return named.join(many, "class_id", "left").select("doc_id", "text_hash", "line_no", "line_id", "class_id", "first_doc", kept.alias("kept"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that are not kept taken out of the texts, other columns unchanged.  Null texts stay null."""
    gone = (line_classes(docs).where("NOT kept").groupBy(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
            .agg(F.collect_set("line_no").alias("gone_lines")))
    joined = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(text_of()) == gone["gone_hash"]), "left")
    left = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains(gone["gone_lines"], i)), "\n")
    return joined.select(*[F.when(gone["gone_lines"].isNull(), docs["text"]).otherwise(left).alias("text") if c == "text" else docs[c] for c in docs.columns])

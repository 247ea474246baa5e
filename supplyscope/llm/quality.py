"""Quality rules: robust multivariate outliers, by DataFrame and SQL functions alone.

``text_statistics`` counts words, symbols, repeated lines and repeated 3-word windows of each whole text inside its row.
``quality_verdicts`` turns the counts into a vector of transformed rates, estimates centre and scatter of each
(lang, source) by minimum covariance determinant, and rejects vectors whose squared Mahalanobis distance
is beyond a chi-square quantile.

The estimate follows the concentration steps of FAST-MCD (Rousseeuw and Van Driessen, 1999): start from the half
of the rows nearest to the coordinate-wise middle, then repeat: mean and covariance of the kept rows, distances of all rows, keep the ``share``
of them with the smallest distance.  Each step is one aggregate over the table of vectors; the rank of a distance is found from
counts of distance bins, so no group is ever sorted or gathered in one task, and a group with a third of all rows costs no more than its share.
The kept set is all rows up to the first bin that reaches the share, so the result does not depend on order or partitioning.

Defined cases: a null or empty text has no words and fails the base rule; null lang or source form groups of their
own; groups with fewer than ``min_rows`` rows are estimated with all other small groups of the language, and languages too small still with all remaining small ones;
the square of a least spread is added to each variance, so a statistic that is constant in a group does not reject small deviations;
repeated rows are judged each; an empty table gives no rows.  Only doc_id, text, lang and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplyscope.llm.common import materialize, text_of

SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\u000b\f\r"
SYMBOLS = "[#*$%&|<>]"

#: The components of a vector, and what is the least spread of each: its square is added to each variance.
FLOORS = {"mean_word": 0.08, "symbol_rate": 0.08, "line_rate": 0.20, "repeat_rate": 0.10}
#: Squared distance beyond which a vector is rejected: the 1 - 1e-6 quantile of chi-square with 4 degrees of freedom.
CUTOFF = 33.4
#: Share of a group that the scatter is taken from, and the factor that makes it consistent at the normal law
#: (share over the chi-square(6) distribution function at the chi-square(4) quantile of the share).
SHARE, CONSISTENCY = 0.75, 1.486
MIN_ROWS = 50
STEPS = 4
BINS_PER_E, BIN_ZERO = 24, 1e-3


def text_statistics(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, ``carry`` columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), one per row of ``docs``."""
    carry = carry or []
    base = docs.select(F.col("doc_id").cast("long"), *carry, text_of().alias("t"))
    trimmed = F.btrim("t", F.lit(SPACE_CHARS))
    split = base.select("doc_id", *carry, "t", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+")).alias("w"),
                        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "").alias("lines"))
    grams = F.when(F.size("w") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    counted = split.select(
        "doc_id", *carry, F.size("w").cast("long").alias("n_words"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), grams.alias("g"))
    placed = counted.withColumn("s", F.when(F.size(F.array_distinct("g")) == F.size("g"), F.lit(None)).otherwise(
        F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    found = placed.withColumn("p", F.sort_array(F.transform(
        F.filter("s", lambda x, k: F.coalesce(x["h"] == F.get("s", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("s", k + 1)["h"], F.lit(False))),
        lambda x: x["i"])))
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("p", k + 1) - x, F.lit(3)))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def with_vectors(stats: DataFrame) -> DataFrame:
    """The statistics with base_failed and the vector: log of the mean word length, square roots of the rates of
    symbols a word and of repeated lines per 20 words, and the share of words in repeated windows."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "mean_word": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "symbol_rate": F.sqrt(F.col("n_symbols") / n),
        "line_rate": F.sqrt(20 * F.col("n_dup_lines") / n),
        "repeat_rate": F.col("n_repeat_words") / n})


def _with_groups(vectors: DataFrame, min_rows: int) -> DataFrame:
    """Adds ``g``, the group whose estimate holds for the row; small groups are pooled by language, then together."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    named = vectors.withColumns({"gl": part("lang"), "gs": part("source")})
    sizes = named.where("NOT base_failed").groupBy("gl", "gs").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < min_rows).groupBy("gl").agg(F.sum("n").alias("pool"))
    keys = sizes.join(small, "gl", "left").select("gl", "gs", F.when(F.col("n") >= min_rows, F.concat_ws("/", "gl", "gs"))
                                                  .when(F.col("pool") >= min_rows, F.concat_ws("/", "gl", F.lit("*"))).otherwise("*").alias("g"))
    return named.join(keys, ["gl", "gs"], "left").drop("gl", "gs")


def _first_centres(rows: DataFrame) -> DataFrame:
    """Coordinate-wise medians of each group, from counts of bins a quarter of the least spread wide."""
    cells = rows.select("g", F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.floor(F.col(c) / (f / 4)).alias("bin")) for c, f in FLOORS.items()])).alias("x"))
    counts = cells.groupBy("g", "x.c", "x.bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("g", "c")
    middle = (counts.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
              .where(F.col("upto") * 2 >= F.col("all")).groupBy("g", "c").agg(F.min("bin").alias("bin")))
    return middle.groupBy("g").agg(*[
        F.max(F.when(F.col("c") == c, (F.col("bin") + 0.5) * (f / 4))).alias(f"m_{c}") for c, f in FLOORS.items()])


def _with_scatter(estimates: DataFrame) -> DataFrame:
    """Adds the lower Cholesky factor l_ij of the scatter s_ij (row by row, lower triangle)."""
    p = len(FLOORS)
    out = estimates
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"s_{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            out = out.withColumn(f"l_{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l_{j}{j}"))
    return out.select("g", *[f"m_{c}" for c in FLOORS], *[f"l_{i}{j}" for i in range(p) for j in range(i + 1)])


def _with_distance(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution with the Cholesky factor."""
    out = rows.join(estimates, "g", how)
    for i, c in enumerate(FLOORS):
        y = F.col(c) - F.col(f"m_{c}")
        for k in range(i):
            y = y - F.col(f"l_{i}{k}") * F.col(f"y_{k}")
        out = out.withColumn(f"y_{i}", y / F.col(f"l_{i}{i}"))
    d2 = sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, len(FLOORS))), F.col("y_0") * F.col("y_0"))
    return out.withColumn("d2", d2).select(*rows.columns, "d2")


def _concentrate(rows: DataFrame, estimates: DataFrame, share: float) -> DataFrame:
    """One step: mean and scatter of the ``share`` of each group nearest to the estimate, in one pass over the rows."""
    names = list(FLOORS)
    near = _with_distance(rows, estimates).withColumn("bin", F.floor(BINS_PER_E * F.log1p(F.col("d2") / BIN_ZERO)))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    bins = near.groupBy("g", "bin").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"a_{c}") for c in names],
                                        *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q_{i}{j}") for i, j in pairs])
    w = Window.partitionBy("g")
    kept = (bins.withColumns({"before": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), "all": F.sum("n").over(w)})
            .where(F.coalesce(F.col("before"), F.lit(0)) < F.col("all") * share))
    sums = kept.groupBy("g").agg(F.sum("n").alias("n"), *[F.sum(f"a_{c}").alias(f"a_{c}") for c in names],
                                 *[F.sum(f"q_{i}{j}").alias(f"q_{i}{j}") for i, j in pairs])
    mean = {c: F.col(f"a_{c}") / F.col("n") for c in names}
    scatter = [((F.col(f"q_{i}{j}") / F.col("n") - mean[names[i]] * mean[names[j]]) * CONSISTENCY
                + (FLOORS[names[i]] ** 2 if i == j else 0.0)).alias(f"s_{i}{j}") for i, j in pairs]
    return sums.select("g", *[m.alias(f"m_{c}") for c, m in mean.items()], *scatter)


def robust_estimates(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Centre and Cholesky factor of the scatter of each group ``g`` of the vectors in ``rows``."""
    pairs = [(i, j) for i in range(len(FLOORS)) for j in range(i + 1)]
    spreads = list(FLOORS.values())
    start = _first_centres(rows).withColumns({f"s_{i}{j}": F.lit(spreads[i] ** 2 if i == j else 0.0) for i, j in pairs})
    estimates = materialize(_with_scatter(start), "mcd", narrow=True)
    for _ in range(steps):
        estimates = materialize(_with_scatter(_concentrate(rows, estimates, share)), "mcd", narrow=True)
    return estimates


def quality_verdicts(docs: DataFrame, share: float = SHARE, cutoff: float = CUTOFF, min_rows: int = MIN_ROWS, steps: int = STEPS) -> DataFrame:
    """Rows (doc_id, text_hash, lang, source, statistics, base_failed, d2, kept), one for each row of ``docs``.

    kept is false where the base rule fails (fewer than 50 words, or more than half of the words in
    repeated 3-word windows), else whether d2 is at most ``cutoff``; d2 is null where the base rule fails.
    """
    own = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
                      "text", F.xxhash64(text_of()).alias("text_hash"))
    stats = text_statistics(own, ["text_hash", "lang", "source"])
    vectors = materialize(with_vectors(stats), "vectors", narrow=True)
    rows = _with_groups(vectors, min_rows)
    estimates = robust_estimates(rows.where("NOT base_failed").select("g", *FLOORS), share, steps)
    judged = _with_distance(rows, estimates, "left")
    d2 = F.when(~F.col("base_failed"), F.col("d2"))
    return judged.select("doc_id", "text_hash", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", d2.alias("d2"), (~F.col("base_failed") & (d2 <= cutoff)).alias("kept"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``quality_verdicts`` keeps, all columns unchanged."""
    bad = (quality_verdicts(docs, **options).where("NOT kept")
           .select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash"), F.col("lang").alias("bad_lang"), F.col("source").alias("bad_source")).distinct())
    same = (docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(text_of()) == bad["bad_hash"])
            & docs["lang"].eqNullSafe(bad["bad_lang"]) & docs["source"].eqNullSafe(bad["bad_source"]))
    return docs.join(bad, same, "left_anti")

"""Mixing sources to target weights by iterative proportional fitting, with DataFrame and SQL functions alone.

Each document has a weight, its number of words, and falls into a cell (source, lang, topic).  Raking multiplies the cells' token weights in turn so that their sums over each source,
each language and each topic meet the target shares (Deming and Stephan, 1940).  A cell's factor is its raked weight over its own tokens; scaled so
that the largest factor is 1, it is the probability with which each document of the cell is sampled, by a uniform number hashed from doc_id and text.
So the expected tokens of the sample have the target marginals, and no document counts twice.

The topic is the first rule of ``TOPICS`` that a text meets, unless the documents are given one.  Where no target is given, it is the observed share to the
power ``alpha``, which lowers large shares and raises small ones.  Only the table of cells is raked: it has a row for each combination of source, language and topic
that occurs, and windows over it take the place of joins.

Defined cases: null sources, languages and topics are values of their own; a null or empty text has weight zero and is sampled like others of its cell; cells without
words, or whose target is zero, have probability zero unless all of their documents are empty, which then have probability 1; values without a given target share what is left
in proportion to their tokens; repeated rows have the same uniform number, so they stay or go together; an empty table gives no rows; columns of the
documents keep their names and values.  Only doc_id, text, lang, source (and topic) are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplyscope.llm.common import discard, materialize, text_of

WORD = "[^\\x20\\x09-\\x0D]+"
#: Topics and the pattern that a text must contain, in order; the last topic holds the rest (fixed values).
TOPICS = (("licence", "[Ll]icen[sc]e|[Cc]opyright|LICENSE|COPYRIGHT"),
          ("contact", "[A-Za-z0-9]@[A-Za-z0-9-]+\\.[A-Za-z]"),
          ("figures", "[0-9]{4}"))
REST = "prose"
ALPHA = 0.9
TOLERANCE, ROUNDS_A_CHECK, MOST_ROUNDS = 1e-6, 4, 40
DIMENSIONS = ("source", "lang", "topic")
ONE_TASK_CELLS = 100_000  # up to so many cells are raked by one task, since a shuffle would cost more; the result is the same


def topic_of(text: Column) -> Column:
    out = F.lit(REST)
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def _targets(cells: DataFrame, given: dict[str, dict[str, float]], alpha: float) -> DataFrame:
    """Adds t_<dimension>: the tokens that each value of the dimension is to have in all."""
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    out = cells.withColumn("all_tokens", whole)
    for d in DIMENSIONS:
        out = out.withColumn("own", F.sum("tokens").over(Window.partitionBy(d)))
        shares = given.get(d)
        if shares is None:
            # values are counted once: the first cell of each carries its part of the sum
            first = F.row_number().over(Window.partitionBy(d).orderBy(*DIMENSIONS)) == 1
            raw = F.when(F.col("own") > 0, F.pow(F.col("own"), F.lit(alpha))).otherwise(0.0)
            out = out.withColumns({"raw": raw, "once": F.when(first, raw).otherwise(0.0)})
            out = out.withColumn(f"t_{d}", F.col("raw") / F.sum("once").over(Window.partitionBy(F.lit(0))) * F.col("all_tokens"))
        else:
            named = F.lit(None).cast("double")
            for value, share in shares.items():
                named = F.when(F.col(d) == value, F.lit(float(share))).otherwise(named)
            rest = F.when(named.isNull(), F.col("tokens")).otherwise(0)
            out = out.withColumns({"named": named, "rest": F.sum(rest).over(Window.partitionBy(F.lit(0)))})
            left = max(0.0, 1.0 - sum(shares.values()))
            out = out.withColumn(f"t_{d}", F.col("all_tokens") * F.coalesce("named", F.lit(left) * F.col("own") / F.col("rest")))
    return out.select(*cells.columns, *[f"t_{d}" for d in DIMENSIONS])


def rake(cells: DataFrame, given: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds ``raked``, the token weight of each cell (source, lang, topic, tokens) after fitting, and ``factor`` = raked / tokens scaled to at most 1.

    Rounds go on until every source and language is within ``tolerance`` of its target (topics, which are fitted last, meet theirs)
    or ``MOST_ROUNDS`` are over, as where the targets contradict each other; the topics' targets hold then.
    """
    now = materialize(cells.withColumn("raked", F.col("tokens").cast("double")), "cells", narrow=True)
    together = (lambda df: df.coalesce(1)) if now.count() <= ONE_TASK_CELLS else (lambda df: df)
    now = materialize(_targets(together(now), given or {}, alpha), "cells", narrow=True)
    for _ in range(0, MOST_ROUNDS, ROUNDS_A_CHECK):
        step = together(now)
        for _ in range(ROUNDS_A_CHECK):
            for d in DIMENSIONS:
                own = F.sum("raked").over(Window.partitionBy(d))
                step = step.withColumn("raked", F.when(F.col("raked") > 0, F.col("raked") * F.col(f"t_{d}") / own).otherwise(0.0))
        before, now = now, materialize(step, "cells", narrow=True)
        discard(before)
        gap = lambda d: F.when((F.col(f"t_{d}") > 0) & (F.sum("tokens").over(Window.partitionBy(d)) > 0),
                               F.abs(F.sum("raked").over(Window.partitionBy(d)) / F.col(f"t_{d}") - 1)).otherwise(0.0)
        gaps = together(now).select(*[gap(d).alias(d) for d in DIMENSIONS])
        if (gaps.agg(F.max(F.greatest(*DIMENSIONS)).alias("gap")).first()["gap"] or 0.0) <= tolerance:
            break
    now = together(now)
    factor = F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(0.0)
    most = F.max("f").over(Window.partitionBy(F.lit(0)))
    return now.withColumn("f", factor).withColumn("factor", F.when(most > 0, F.col("f") / most).otherwise(1.0)).drop("f")


def with_cells(docs: DataFrame, seed: int) -> DataFrame:
    """Rows (doc_id, source, lang, topic, n_tokens, uniform), one for each row of ``docs``."""
    topic = F.col("topic").cast("string") if "topic" in docs.columns else topic_of(F.col("t"))
    base = docs.withColumn("t", text_of()) if "t" not in docs.columns else docs.drop("t").withColumn("t", text_of())
    return base.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                       topic.alias("topic"), F.regexp_count("t", F.lit(WORD)).cast("long").alias("n_tokens"), _uniform(F.col("t"), seed).alias("uniform"))


def _uniform(text: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text), F.lit(1 << 53)) / float(1 << 53)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA, seed: int = 11) -> DataFrame:
    """Rows (doc_id, source, lang, topic, n_tokens, uniform, probability, kept), one for each row of ``docs``.

    ``targets`` may give shares of the tokens by value for source, lang or topic.
    """
    rows = materialize(with_cells(docs, seed), "mixing", narrow=True)
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    factors = rake(cells, targets, alpha).select(*[F.col(d).alias(f"c_{d}") for d in DIMENSIONS], F.col("factor"),
                                                 (F.col("tokens") == 0).alias("empty"))
    factors = materialize(factors, "factors", narrow=True)
    same = [rows[d].eqNullSafe(factors[f"c_{d}"]) for d in DIMENSIONS]
    joined = rows.join(factors, same[0] & same[1] & same[2], "left")
    probability = F.when(F.col("empty"), 1.0).otherwise(F.col("factor"))
    return joined.select("doc_id", *DIMENSIONS, "n_tokens", "uniform", probability.alias("probability"), (F.col("uniform") < probability).alias("kept"))


def sample_mixture(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` that ``mix`` samples, all columns unchanged."""
    gone = mix(docs, targets, alpha, seed).where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("uniform").alias("gone_uniform")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (_uniform(text_of(), seed) == gone["gone_uniform"]), "left_anti")

"""Mixing sources to target weights by hash-threshold histograms.  DataFrame functions only.

A target is a whole number of passes over its source plus a remainder.  The remainder is taken by
a threshold on a keyed hash of the row: words are summed by source and hash bucket, the running
sum finds the bucket in which the budget runs out, and only that bucket is refined, by the next
bits of the hash.  Nothing is sorted but at most 4,096 bucket sums a source, and rows are then
chosen by one comparison.  A hot source is summed map side like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut, drop_cut, fresh

WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the corpus, as a fraction.
SHARE = (3, 2)
#: A target stops at so many times its source.
MOST = 2
SEED = "mix-1"
#: The hash has 60 bits and is refined 12 at a time.
HASH_BITS, STEP_BITS = 60, 12
#: Copies of one row that one task makes.
RUN_ROWS = 16_384


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text_md5: Column, copy: Column | int = 0, seed: str = SEED) -> Column:
    """The first 60 bits of the MD5 of seed, id, text and number of the copy; a null id hashes as the empty text.

    The text takes part so that rows with one id, or none, are not taken or left together.
    """
    copy = copy if isinstance(copy, Column) else F.lit(copy)
    keyed = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), text_md5, copy.cast("string"))
    return F.conv(F.substring(F.md5(keyed.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def text_md5(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code-point order, null last, take the weights in turn.  A level ``t`` is shared by
    weight; sources whose share passes ``MOST`` times their size stop there.  In order of size by
    weight the stopped ones come first, so running sums find the level in one pass over the
    sources (one row a source, after aggregation).
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    by_source = by_source.select(
        "source", "source_size", F.element_at(F.array([F.lit(w) for w in weights]), (place + 1).cast("int")).alias("w")
    )
    filling = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = by_source.select(
        "*",
        (F.col("source_size") * MOST).alias("most"),
        (F.sum("source_size").over(everything) * SHARE[0] / SHARE[1]).alias("all_words"),
        F.coalesce(F.sum("source_size").over(before) * MOST, F.lit(0)).alias("stopped"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("open_w"),
    ).select("*", ((F.col("all_words") - F.col("stopped")) / F.col("open_w")).alias("level"))
    filled = filled.withColumn("place", F.row_number().over(filling))
    fits = F.when(F.col("most") > F.col("level") * F.col("w"), F.struct("place", "level"))
    return filled.select("*", F.min(fits).over(everything)["level"].alias("final")).select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("most").cast("double"), F.col("final") * F.col("w")), F.lit(0.0)).alias("target"),
    )


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, source_size, target, passes, bound): rows with ``hash < bound`` get one more pass.

    ``sized`` has (source, size, hash).  The budget ends inside one bucket; refining it leaves one
    hash value, which is taken if that brings the sum nearer to the budget.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = plan.withColumn("passes", passes.cast("int")).select(
        "*",
        (F.col("target") - F.col("passes") * F.col("source_size")).alias("budget"),
        F.lit(0).cast("long").alias("prefix"),
    )
    state = state.withColumn("budget", F.when(F.col("budget") > 0, F.col("budget")))
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        state = _refine(sized, state, shift)
        old, state = state, cut(state)
        drop_cut(old)
        if shift == HASH_BITS - STEP_BITS:  # later passes read the boundary buckets alone
            inside = state.where("budget IS NOT NULL").select(F.col("source").alias("of"), "prefix")
            same = F.col("source").eqNullSafe(F.col("of")) & (F.shiftrightunsigned("hash", shift) == F.col("prefix"))
            sized = cut(sized.join(inside, same, "left_semi"))
    drop_cut(sized)
    last = F.col("edge_size") - F.col("budget") < F.col("budget")
    return state.select(
        "source",
        "source_size",
        "target",
        "passes",
        F.when(F.col("edge_size").isNull(), F.lit(0)).otherwise(F.col("prefix") + last.cast("long")).alias("bound"),
    )


def _refine(sized: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """The boundary bucket of each source, ``STEP_BITS`` deeper."""
    kept = ["source", "source_size", "target", "passes"]
    inside = state.where("budget is not null").select(F.col("source").alias("of"), "prefix", "budget")
    same = F.col("source").eqNullSafe(F.col("of")) & (
        F.shiftrightunsigned("hash", shift + STEP_BITS) == F.col("prefix")
    )
    sums = (
        sized.join(inside, same)
        .groupBy("of", F.shiftrightunsigned("hash", shift).alias("bucket"))
        .agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    )
    upto = F.sum("words").over(Window.partitionBy("of").orderBy("bucket"))
    edge = (
        sums.select("*", upto.alias("upto"))
        .where("upto > budget")
        .groupBy("of")
        .agg(F.min(F.struct("bucket", "upto", "words")).alias("edge"))
    )
    return state.join(edge, F.col("source").eqNullSafe(F.col("of")), "left").select(
        *kept,
        (F.col("budget") - (F.col("edge.upto") - F.col("edge.words"))).alias("budget"),
        F.coalesce("edge.bucket", F.lit(0)).alias("prefix"),
        F.col("edge.words").alias("edge_size"),
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED
) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, passes, and its source.

    Null texts have size 0; null sources are one source, last in order; very long texts are counted
    whole.  Null or repeated ids are told apart by their texts, and rows equal in id, source and text
    by a number from 0, so each is taken or left on its own.  Documents of size 0 are taken as 0
    words.  An empty table gives no rows.  Columns other than the three named are not read, so their
    names cannot clash.  Reruns agree: hashes depend on seed, id, text and that number alone.
    """
    kinds = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        text_md5(F.col(text_col)).alias("md5"),
    )
    kinds = cut(kinds.groupBy("doc_id", "source", "size", "md5").agg(F.count("*").alias("n")))
    if (kinds.agg(F.max("n")).first()[0] or 0) > RUN_ROWS:  # the copies of one row are made by several tasks
        runs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN_ROWS).cast("long")))
        kinds = kinds.select("*", runs.alias("run")).repartition("md5", "run")
        kinds = kinds.withColumn("n", F.least(F.col("n") - F.col("run"), F.lit(RUN_ROWS)))
    else:
        kinds = kinds.withColumn("run", F.lit(0).cast("long"))
    copies = F.explode(F.sequence(F.col("run"), F.col("run") + F.col("n") - 1)).alias("copy")
    sized = kinds.select("doc_id", "source", "size", "md5", copies)
    sized = cut(sized.select("doc_id", "source", "size", row_hash(F.col("doc_id"), F.col("md5"), F.col("copy"), seed).alias("hash")))
    bounds = thresholds(sized, cut(targets(sized)))
    bounds = bounds.withColumnRenamed("source", "of")
    times = F.col("passes") + (F.col("hash") < F.col("bound")).cast("int")
    return sized.join(bounds, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * times).alias("taken"),
        times.alias("passes"),
    )


def resample(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as the mix takes it: never, once or twice.

    Only the few numbers a source are joined to the texts; columns and their names stay as they were.
    Null texts have size 0, null sources are one source, very long texts are counted whole, and an
    empty table stays empty.  Rows with one id are told apart by their texts; rows equal in both are
    taken together, so a source of such rows alone may miss its target: remove copies before.
    """
    size, key, of, bound, times = (fresh(docs, x) for x in ("size", "hash", "of", "bound", "times"))
    marked = docs.select(
        "*", n_words(F.col(text_col)).alias(size), row_hash(F.col(id_col), text_md5(F.col(text_col))).alias(key)
    )
    sized = cut(marked.select(F.col(source_col).alias("source"), F.col(size).alias("size"), F.col(key).alias("hash")))
    bounds = thresholds(sized, cut(targets(sized))).select(
        F.col("source").alias(of), F.col("bound").alias(bound), F.col("passes").alias(times)
    )
    joined = docs.withColumn(key, row_hash(F.col(id_col), text_md5(F.col(text_col)))).join(bounds, F.col(source_col).eqNullSafe(F.col(of)))
    often = F.col(times) + (F.col(key) < F.col(bound)).cast("int")
    copies = joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), often)).alias(times))
    return copies.select(*docs.columns)

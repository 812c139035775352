"""Mixing sources to target weights along a time-varying curriculum.

A source's demand for words over training time t in [0, 1] is its target times the integral of
its schedule. Its documents stand in md5 order and repeat in epochs; the demand, inverted at a
document's place in that stream, gives its training position; documents are range-sorted by it.

Null texts have no words. A null source is a source of its own, ranked last. Repeated rows share
the stream one after another; rows that share only an id, or have none, stand by a hash of their text.
Positions are not rounded, and equal ones stand by doc_id. Documents of no words take no position and
no words. Texts of any length are read whole; columns of other names pass through. An empty table gives
an empty result. A source takes its target rounded to whole words; the last
document of a stream may be taken in part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import attach, hash_order, materialise, prefix_digits, running_total

WEIGHTS = (1, 2, 3)
#: Per source in turn: (time, relative weight) knots from time 0 to 1, linear between them.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)))
MOST_EPOCHS = 3

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def time_of(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Invert the schedule's integral, scaled to 1: the time at which ``share`` of it has passed."""
    pieces = [(t0, w0, (w1 - w0) / (t1 - t0), (t1 - t0) * (w0 + w1) / 2) for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    whole = sum(area for *_, area in pieces)
    out, before = None, whole
    for t0, w0, slope, area in reversed(pieces):
        before -= area
        part = share * whole - before
        # the root of slope / 2 * x^2 + w0 * x = part, in the form that also holds for slope 0
        found = t0 + 2 * part / (w0 + F.sqrt(w0 * w0 + 2 * slope * part))
        out = found if out is None else F.when(share * whole < before + area, found).otherwise(out)
    return out


def scheduled(share: Column, rank: Column, schedules) -> Column:
    """The training position of a share of the stream of the source with this rank."""
    found = [F.when(rank % len(schedules) == k, time_of(share, knots)) for k, knots in enumerate(schedules)]
    return F.coalesce(*found)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """sizes: source, source_size. Adds rank by code point and target.

    Targets are min(most * size, level * weight) with the level at which they sum to all words:
    where resharing ends. The level is the largest of those that hold when the sources with the
    lowest caps per weight stop at their caps. There is a row a source, so one task may sort them.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * most).cast("double")
    by_cap = Window.orderBy("per_weight", "rank")
    return (
        ranked.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("per_weight", F.col("cap") / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(everything) - F.col("capped")) / F.col("open"))
        .withColumn("level", F.max("level").over(everything))
        .select("source", "rank", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))
    )


def plan(documents: DataFrame, weights: Sequence[float] = WEIGHTS, schedules=SCHEDULES, keep: Sequence[str] = ()) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, position, and the columns of ``keep``."""
    version = F.xxhash64(F.col("text").cast("string"))
    order = hash_order(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), version.cast("string"))))
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), order.alias("__order"), version.alias("__version"), *keep)
    sized = materialise(base)
    sources = materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).drop("n"), weights)).withColumnRenamed("source", "__source")
    rows = sized.count()
    goal = F.col("source").eqNullSafe(F.col("__source"))
    placed = attach(sized, sources, goal).withColumn("__bucket", F.substring("__order", 1, prefix_digits(rows)))
    before = running_total(placed, ["rank"], "__bucket", ["__order", "doc_id", "size", "__version"], "size", "before")
    streams = (
        before.withColumn("stream", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn("epochs", F.expr("if(source_size > 0, stream div source_size, 0)"))
        .withColumn("rest", F.expr("if(source_size > 0, stream % source_size, 0)"))
        .withColumn("taken", F.col("size") * F.col("epochs") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before"))))
    )
    position = F.when(F.col("taken") > 0, scheduled(F.try_divide("before", "stream"), F.col("rank"), schedules))
    return streams.withColumn("position", position).select("doc_id", "size", "source_size", "target", "taken", "position", "before", "stream", "rank", *keep)


def mix(documents: DataFrame, weights: Sequence[float] = WEIGHTS, schedules=SCHEDULES) -> DataFrame:
    """Every document with the words the mix takes of it, in training order (untaken ones first)."""
    return plan(documents, weights, schedules).drop("before", "stream", "rank").orderBy("position", "doc_id")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    space = "\\x20\\x09-\\x0D"
    return F.array_join(F.slice(F.split(text, f"(?<=[^{space}])(?=[{space}])"), 1, n), "")


def mixed_documents(documents: DataFrame, weights: Sequence[float] = WEIGHTS, schedules=SCHEDULES) -> DataFrame:
    """The training stream with the columns of documents: a row for each time a document is taken.

    Documents that are taken k times occur k times; the one where a source's stream ends is cut
    after the last word taken. Rows are range-sorted by training position.
    """
    columns = [F.col(f"`{c}`") for c in documents.columns]
    whole = documents.select("doc_id", "source", "text", F.struct(*columns).alias("__row"))
    copies = "transform(sequence(0, cast(ceil(taken / size) as int) - 1), e -> struct(e as epoch, cast(least(size, taken - e * size) as int) as words))"
    each = plan(whole, weights, schedules, keep=["__row"]).where("taken > 0").withColumn("__copy", F.explode(F.expr(copies)))
    share = (F.col("before") + F.col("__copy.epoch") * F.col("source_size")) / F.col("stream")
    cut = F.when(F.col("__copy.words") < F.col("size"), first_words(F.col("__row.text").cast("string"), F.col("__copy.words"))).otherwise(F.col("__row.text").cast("string"))
    return (
        each.withColumn("__position", scheduled(share, F.col("rank"), schedules))
        .withColumn("__text", cut)
        .orderBy("__position", "doc_id")
        .select(*[F.col("__text").cast(documents.schema["text"].dataType).alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in documents.columns])
    )

"""Near-duplicate documents by BagMinHash.

A document is a bag of five-word shingles. Over each shingle and level of weight runs a Poisson
process whose points fall on the signature's registers; a register keeps its earliest point. Weights
are discretised to whole levels, and levels are grouped into dyadic nodes (0,1], (1,2], (2,4], ...: a
node has one process of its width's rate, and a point counts if its level is within the weight. Equal
shingles share their processes, so two registers agree with the probability of the weighted Jaccard
similarity, without bias. Points come in time order, and a shingle stops at the latest register.

Bands of registers propose pairs. In each bucket, members are first compared with the least of them,
then, where a bucket still spans several classes, with two leaders in turn, then across the classes: a
pair within a class proves nothing new, so the classes are those of all proposed pairs. Of pairs across
classes only those go on whose longer sketches agree nearly enough. Pairs are verified by the exact
weighted Jaccard overlap of 64-bit shingle hashes. The join across classes is by bucket, which Spark
splits where one is large.

Words are split at ASCII white space. Texts of equal shingles are one text. Texts of fewer than five
words are one shingle; texts without words and nulls have no class but their own. Rows of a null id are
kept and have a null class. Rows that share an id are judged by their texts: only rows of the same id and
text are one, and of them any one stays, for their other columns don't count. Of a class the least id
stays. Very long texts are read whole, by slices of bounded size. Columns of other names pass through. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import BROADCAST_ROWS, forget, free_shuffles, ids_and_texts, map_arrow, materialise, slices
from lodestar.llm.graph import components
from lodestar.llm.shingles import FACTOR, STEP, as_set, bags, common, mix

SIMILARITY = 0.8
#: With 64 bands of 8 registers a pair of similarity 0.8 stays unproposed with a chance of 8 in 10^6,
#: and one of 0.5 is proposed with a chance of a fifth.
BANDS, ROWS = 64, 8
REGISTERS = BANDS * ROWS
#: Points that are drawn in a step, if so many processes or fewer go on.
POINTS_AT_ONCE = 8192
#: Documents whose points are drawn together.
TOGETHER = 64
#: Registers of the one-bit sketches that pairs across classes are first compared by, and how far below
#: the similarity their estimate may be: at 0.8 it falls lower with a chance of 1 in 10^6.
SKETCH, SLACK = 4096, 0.046
#: The round that compares across classes; those before it, members with leaders.
LEADER_ROUNDS = 2


def points(elements: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """The registers (n x registers, a power of two) of n bags: elements with their bag's number and whole weight."""
    depth = np.ceil(np.log2(np.maximum(weight, 1))).astype("int64") + 1  # nodes that reach the weight
    which = np.repeat(np.arange(len(elements)), depth)
    node = np.arange(len(which)) - np.repeat(np.cumsum(depth) - depth, depth)
    first = np.full(n * registers, np.inf)
    state = mix(elements[which] + (node.astype("uint64") + np.uint64(1)) * STEP)
    one = node == 0  # of one level: every point counts
    low = 2.0 ** np.maximum(node - 1, 0)
    for chosen in (one, ~one):
        _draw(first, state[chosen], owner[which[chosen]], registers, None if chosen is one else low[chosen], weight[which[chosen]])
    return first.reshape(n, registers)


def _draw(first: np.ndarray, seed: np.ndarray, owner: np.ndarray, registers: int, low: np.ndarray | None, weight: np.ndarray) -> None:
    """Points of every process in turn, in time order, until none can be a register's first.

    The fewer processes go on, the more points of each are drawn at once.
    """
    base, time, rest = owner * registers, np.zeros(len(seed)), np.uint64(registers - 1)
    rate = np.full(1, 1.0 / registers) if low is None else 1.0 / (registers * low)
    drawn = 1
    while len(seed):
        many = max(1, min(64, POINTS_AT_ONCE // len(seed)))
        state = mix(seed[:, None] + np.arange(drawn, drawn + many, dtype="uint64")[None, :] * STEP)
        drawn += many
        gap = (state >> np.uint64(11)).astype("float64")  # the other bits choose the register
        gap *= -(2.0**-53)
        np.log1p(gap, out=gap)
        gap *= -rate[:, None]
        gap[:, 0] += time
        times = np.cumsum(gap, axis=1, out=gap) if many > 1 else gap
        at = base[:, None] + (state & rest).astype("int64")
        if low is None:
            np.minimum.at(first, at.ravel(), times.ravel())
        else:
            level = low[:, None] + np.ceil(((mix(state ^ STEP) >> np.uint64(40)).astype("float64") + 1) * 2.0**-24 * low[:, None])
            use = level <= weight[:, None]
            np.minimum.at(first, at[use], times[use])
        time = times[:, -1]
        on = time < first.reshape(-1, registers).max(axis=1)[base // registers]
        if not on.all():
            seed, time, base = seed[on], time[on], base[on]
            if low is not None:
                low, weight, rate = low[on], weight[on], rate[on]


def bands(registers: np.ndarray) -> np.ndarray:
    """A hash per band of the times' bits."""
    bits = registers.view("uint64").reshape(len(registers), BANDS, ROWS)
    found = np.broadcast_to(np.arange(1, BANDS + 1, dtype="uint64") * STEP, bits.shape[:2]).copy()
    for k in range(ROWS):
        found = mix(found + bits[:, :, k])
    return found


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, key (of the words) and bands of every document with an id and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TOGETHER):
            found = bags(batch.column(1))
            rows = [k for k, bag in enumerate(found) if len(bag)]
            if rows:
                sets, counts = zip(*(np.unique(found[k], return_counts=True) for k in rows))
                # the sums of both finalised hashes: 128 bits of the multiset
                keys = [b"".join(int(mix(found[k] ^ c).sum()).to_bytes(8, "little") for c in (STEP, FACTOR)) for k in rows]
                owner = np.repeat(np.arange(len(rows)), [len(b) for b in sets])
                drawn = bands(points(np.concatenate(sets), owner, np.concatenate(counts), len(rows)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, drawn.size + 1, BANDS), pa.int32()), pa.array(drawn.view("int64").ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(keys, pa.binary()), flat], names=["doc_id", "key", "bands"])

    return map_arrow(ids_and_texts(documents).where("doc_id is not null"), run, "doc_id long, key binary, bands array<long>")


def bags_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, bag (sorted hashes as bytes) of the documents whose ids are wanted; the ids are broadcast if few."""
    few = wanted.count() <= 10 * BROADCAST_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [as_set(bag).tobytes() for bag in bags(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "bag"])

    rows = ids_and_texts(documents).join(F.broadcast(wanted) if few else wanted, F.col("doc_id") == F.col("node"), "left_semi")
    return map_arrow(rows, run, "node long, bag binary")


def sketches(held: DataFrame) -> DataFrame:
    """node and sketch: one bit of each of ``SKETCH`` registers, as whole numbers of 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TOGETHER):
            found = [np.frombuffer(b, "uint64") for b in batch.column(1).to_pylist()]
            owner, every = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate(found)
            bits = mix(points(every, owner, np.ones(len(every), "int64"), len(found), SKETCH).view("uint64")) & np.uint64(1)
            flat = np.packbits(bits.astype("uint8"), axis=1).view("int64").ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, SKETCH // 64), pa.int32()), pa.array(flat))], names=["node", "sketch"])

    return map_arrow(held, run, "node long, sketch array<long>")


def unlike(a: str, b: str) -> Column:
    """In how many bits two sketches differ: half of 1 minus the similarity is to be expected."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(SKETCH // 64)])


def verify(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of at least that weighted Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                small, large = sorted((len(x), len(y)))
                shared = common(np.frombuffer(x, "uint64"), np.frombuffer(y, "uint64")) if small >= similarity * large else 0
                kept.append(shared >= similarity * ((small + large) // 8 - shared) and shared > 0)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(kept, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    both = pairs.join(held.toDF("a", "bag_a"), "a").join(held.toDF("b", "bag_b"), "b").select("a", "b", "bag_a", "bag_b")
    return map_arrow(both, run, "a long, b long")


def labelled(rows: DataFrame, labels: DataFrame, few: bool) -> DataFrame:
    """Rows with the label of their node, its own number where it has none."""
    return rows.join(F.broadcast(labels) if few else labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def merged(labels: DataFrame, edges: DataFrame, few: bool) -> DataFrame:
    """node, label after further edges between nodes: components of the classes that they link."""
    ends = edges
    for c in "ab":
        ends = labelled(ends.withColumnRenamed(c, "node"), labels, few).drop("node").withColumnRenamed("label", c)
    above = materialise(components(ends)).toDF("label", "above")
    old = labels.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
    return old.union(above.join(labels.select(F.col("node").alias("label")), "label", "left_anti"))  # classes of one until now


def next_pairs(buckets: DataFrame, labels: DataFrame, few: bool, turn: int, held: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different classes in a bucket: of each member with two leaders, other ones in each
    bucket and turn; in the last turn all whose sketches are nearly alike enough."""
    named = labelled(buckets, labels, few)
    order = F.xxhash64("node", "band", F.lit(turn))
    leads = [f(F.struct(order.alias("h"), "node", "label")) for f in (F.min, F.max)]
    wide = named.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.array(*leads).alias("leads")).where("x != y").select("band", "leads")
    if turn < LEADER_ROUNDS:
        each = named.join(wide, "band").withColumn("lead", F.explode("leads")).where("label != lead.label")
        return each.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
    open_ = materialise(named.join(wide.select("band"), "band"))
    drawn = materialise(sketches(held.join(open_.select("node").distinct(), "node", "left_semi")))
    marked = materialise(open_.join(drawn, "node"))
    left, right = (marked.select("band", F.col("node").alias(x), F.col("label").alias(f"label_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    alike = unlike("sketch_a", "sketch_b") <= int(SKETCH * (1 - similarity + SLACK) / 2)
    return left.join(right, "band").where((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & alike).select("a", "b").distinct()


def classes(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least id of its class) of every document with an id and words."""
    signed = materialise(signatures(documents))
    texts = signed.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    rows = texts.select("node", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("members")).where("members > 1")
    buckets = materialise(rows.join(shared, "band"))  # of several texts
    pairs = materialise(buckets.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    held = materialise(bags_of(documents, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    labels = materialise(components(verify(pairs, held, similarity)))
    free_shuffles(documents.sparkSession)
    several = buckets.where("members > 2").select("band", "node")  # in a bucket of two, that pair has been tried
    for turn in range(1, LEADER_ROUNDS + 1):
        few = labels.count() <= 10 * BROADCAST_ROWS
        found = materialise(verify(next_pairs(several, labels, few, turn, held, similarity), held, similarity))
        if not found.isEmpty():
            labels = materialise(merged(labels, found, few))
    forget(buckets, pairs, held)
    labels = F.broadcast(labels) if labels.count() <= 10 * BROADCAST_ROWS else labels
    own = labelled(signed.groupBy("key").agg(F.min("doc_id").alias("node")), labels, False).select("key", F.col("label").alias("class_id"))
    return signed.select("doc_id", "key").join(own, "key").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def apart(documents: DataFrame) -> tuple[DataFrame, bool]:
    """All rows and columns of documents and __own, an id of each id's text; and whether any id has several texts.

    It is the doc_id, or a hash of id and text where the id has several.
    """
    doc, version = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    texts = documents.select(doc.alias("__doc"), version.alias("v")).where("__doc is not null")
    several = materialise(texts.groupBy("__doc").agg(F.min("v").alias("least"), F.max("v").alias("most")).where("least != most").select("__doc"))
    many = several.count()
    if not many:
        return documents.withColumn("__own", doc), False
    joined = documents.join(F.broadcast(several) if many <= BROADCAST_ROWS else several, doc == F.col("__doc"), "left")
    return joined.withColumn("__own", F.when(F.col("__doc").isNull(), doc).otherwise(F.xxhash64(doc, version))).drop("__doc"), True


def own_classes(rows: DataFrame, several: bool, similarity: float) -> DataFrame:
    """__own, class_id (the least doc_id of its class) and first (its __own) of every text with an id and words."""
    found = classes(rows.select(F.col("__own").alias("doc_id"), "text"), similarity).withColumnRenamed("doc_id", "__own")
    if not several:
        return found.withColumn("first", F.col("class_id"))
    named = materialise(found.join(rows.select("__own", F.col("doc_id").cast("long").alias("doc_id")).distinct(), "__own"))
    least = named.groupBy("class_id").agg(F.min(F.struct("doc_id", "__own")).alias("l"))
    return named.join(least, "class_id").select("__own", F.col("l.doc_id").alias("class_id"), F.col("l.__own").alias("first"))


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id and kept of every row: the text of the least id of the class stays."""
    rows, several = apart(documents)
    found = own_classes(rows, several, similarity)
    joined = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "__own").join(found, "__own", "left")
    return joined.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("first") == F.col("__own"), F.lit(True)).alias("kept"))


def without_near_duplicates(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows that stay, all columns: one of each class; of rows that share both id and text, one."""
    rows, several = apart(documents)
    later = own_classes(rows, several, similarity).where("first != __own").select(F.col("__own").alias("__later"))
    few = materialise(later)
    gone = F.broadcast(few) if few.count() <= 10 * BROADCAST_ROWS else few
    kept = rows.join(gone, F.col("__own") == F.col("__later"), "left_anti")
    unique = rows.groupBy("__own").count().where("count > 1 and __own is not null").isEmpty()
    kept = kept if unique else kept.where("__own is not null").dropDuplicates(["__own"]).unionByName(kept.where("__own is null"))
    return kept.drop("__own")

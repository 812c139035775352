"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity, as counted over all lines in a table of
fixed size, then by hash: a total order, and any total order makes the join exact; this one keeps
posting lists short. Lines of Jaccard similarity t or more share a word of their prefixes, the
n - ceil(t * n) + 1 rarest words. Lengths, places in the prefix and 128-bit parity sketches of the sets,
which bound how much two sets share, rule out nearly all pairs that don't match; the sets are compared
for the rest. A line goes if an earlier line (by doc_id, then line number) matches it.

Lines of equal sets are found by one aggregation, so copies are never paired. Postings travel packed
and are joined inside groups of bounded size; the lists of very frequent words are dealt out by set. A
set keeps its most alike earlier sets in each group, so a family of similar lines never becomes all its
pairs. A set that none of those matches, though there were more, is asked against all lines in blocks.

Lines without words, null texts and rows of a null id stay as they are. Rows that repeat both id and
text are the same lines, and keep or lose them alike; among rows that share only an id, equal places are
ordered by the lines' hashes. Very long texts are read whole, by slices of bounded size. Columns of any
other names pass through. An empty table gives an empty result. Equality of words is that of 64-bit
hashes. Words are split at ASCII white space.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import attach, forget, free_shuffles, group_arrow, is_small, map_arrow, materialise, slices
from lodestar.llm.shingles import FACTOR, STEP, Words, common, mix

SIMILARITY = 0.8
#: Cells of the table that counts words, and in how many parts it travels.
CELLS, PARTS = 1 << 20, 16
RANK_BITS = 20
#: Documents whose lines are looked at together.
TOGETHER = 128
#: Postings in a group that a task joins, and postings gathered before they are dealt out.
GROUP, GATHERED = 400_000, 300_000
#: Sets in the list of a word; longer ones are dealt out to several groups.
LONG = 50_000
#: Pairs that are looked at together.
PAIRS = 400_000
#: Earlier sets that a set keeps in a group, and of all its groups' how many it is compared with first.
KEPT, FIRST = 4, 2
#: Open sets that are asked together against all lines.
ASKED = 30_000


def least_common(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many words sets of n words together (counting both) must share."""
    return np.ceil(similarity / (1 + similarity) * n - 1e-9).astype("int64")


def prefix_of(n: np.ndarray, similarity: float) -> np.ndarray:
    """So many of the rarest words that similar sets share one."""
    return n - np.ceil(similarity * n - 1e-9).astype("int64") + 1


def in_order(line: np.ndarray, word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The order by line, rank and word: one sort of packed keys, all three where those tie."""
    room = 64 - max(1, int(line[-1]).bit_length() if len(line) else 1)
    packed = (line.astype("uint64") << np.uint64(room)) | (rank << np.uint64(room - RANK_BITS)) | (word >> np.uint64(64 - room + RANK_BITS))
    order = np.argsort(packed)
    packed, sorted_ = packed[order], word[order]
    if ((packed[1:] == packed[:-1]) & (sorted_[1:] != sorted_[:-1])).any():
        order = np.lexsort((word, rank, line))
    return order


class Lines:
    """The lines with words of a text column: doc (row), number, n words, k1 and k2 (128 bits of the set).

    ``line`` and ``word`` hold the sets, by line and in the order of rarity; ``place`` is a word's there.
    """

    def __init__(self, texts: pa.Array, counted: np.ndarray | None = None):
        words = Words(texts)
        new = np.ones(len(words.hash), bool)
        new[1:] = (words.doc[1:] != words.doc[:-1]) | (words.line[1:] != words.line[:-1])
        begin = np.flatnonzero(new)
        line = np.cumsum(new) - 1
        self.doc, self.number = words.doc[begin], words.line[begin].astype("int32")
        rank = np.zeros(len(line), "uint64") if counted is None else np.minimum(counted[cell_of(words.hash)], (1 << RANK_BITS) - 1).astype("uint64")
        order = in_order(line, words.hash, rank)
        line, word = line[order], words.hash[order]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (word[1:] != word[:-1])
        self.line, self.word = line[new], word[new]
        self.start = np.flatnonzero(np.append(True, self.line[1:] != self.line[:-1])) if len(line) else np.empty(0, "int64")
        self.n = np.diff(np.append(self.start, len(self.line)))
        self.place = np.arange(len(self.line)) - self.start[self.line]
        self.k1, self.k2 = (np.add.reduceat(mix(self.word ^ k), self.start).view("int64") if len(line) else np.empty(0, "int64") for k in (STEP, FACTOR))

    def parity(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set: words flip one each. Sets differ in as many words as bits, at least."""
        bit = mix(self.word ^ FACTOR)
        one = np.uint64(1) << (bit & np.uint64(63))
        high = (bit & np.uint64(64)) > 0
        return tuple(np.bitwise_xor.reduceat(np.where(side, one, np.uint64(0)), self.start) if len(self.start) else np.empty(0, "uint64") for side in (high, ~high))


def cell_of(word: np.ndarray) -> np.ndarray:
    return (word & np.uint64(CELLS - 1)).astype("int64")


def named(documents: DataFrame) -> DataFrame:
    """doc_id, version (a hash of the text) and text of the rows that take part."""
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text")).where("doc_id is not null and text is not null")


def survey(rows: DataFrame) -> DataFrame:
    """Two kinds of rows: for each line its set's key and size; and the counts of words, in parts.

    Counts stop at 65,535 in a task: beyond it a word is frequent anyway, and any order is exact.
    """
    names = ["doc_id", "version", "line", "k1", "k2", "n", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(CELLS, "int64"), [], 0
        for batch in slices(batches, TOGETHER):
            lines = Lines(batch.column(2))
            held.append(cell_of(lines.word))
            size += len(lines.word)
            if size >= CELLS:
                counts += np.bincount(np.concatenate(held), minlength=CELLS)
                held, size = [], 0
            own = [batch.column(c).take(pa.array(lines.doc)) for c in (0, 1)]
            void = [pa.nulls(len(lines.doc), t) for t in (pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (lines.number, lines.k1, lines.k2, lines.n.astype("int32"))), *void], names=names)
        if held:
            counts += np.bincount(np.concatenate(held), minlength=CELLS)
        if counts.any():
            parts = [p.astype("<u2").tobytes() for p in np.minimum(counts, 2**16 - 1).reshape(PARTS, -1)]
            void = [pa.nulls(PARTS, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*void, pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return map_arrow(rows, run, "doc_id long, version long, line int, k1 long, k2 long, n int, part int, counts binary")


def total_counts(surveyed: DataFrame) -> np.ndarray:
    """The table of all counts: parts are added in two levels, so no task sums those of all tasks."""

    def adding(kind: str):
        def add(table: pa.Table) -> pa.Table:
            whole = np.zeros(CELLS // PARTS, "int64")
            for x in table.column("counts"):
                whole += np.frombuffer(x.as_buffer(), kind)
            return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(whole, 2**32 - 1).astype("<u4").tobytes()], pa.binary())})

        return add

    found = surveyed.where("part is not null").select("part", "counts", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(16)).alias("lot"))
    some = group_arrow(found, ["part", "lot"], adding("<u2"), "part int, counts binary")
    parts = {r["part"]: r["counts"] for r in group_arrow(some, ["part"], adding("<u4"), "part int, counts binary").collect()}  # PARTS rows, CELLS numbers
    return np.concatenate([np.frombuffer(parts.get(p, bytes(4 * CELLS // PARTS)), "<u4") for p in range(PARTS)])


#: Columns of packed postings with their types; bytes travel by place, so that leading zeros compress.
PACKED = {"word": "uint32", "k1": "int64", "doc": "int64", "line": "int32", "n": "int32", "place": "int32", "p0": "uint64", "p1": "uint64", "split": "uint8"}


def pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view("uint8").reshape(len(x), -1).T).tobytes()


def unpack(parts: pa.ChunkedArray, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.concatenate([np.ascontiguousarray(np.frombuffer(b.as_buffer(), "uint8").reshape(width, -1).T).view(kind).ravel() for b in parts])


def postings(rows: DataFrame, counted: np.ndarray, groups: int, similarity: float, long: int = LONG) -> DataFrame:
    """Packed postings of the prefixes, by group.

    Where a word's count would make a list longer than ``long``, sets are dealt to several groups by
    their key, and the posting is marked ``split``.
    """
    shared = rows.sparkSession.sparkContext.broadcast(counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = shared.value
        lines_held, held, size, base = [], [], 0, 0

        def dealt() -> pa.RecordBatch:
            k1, doc, number, n, p0, p1 = (np.concatenate(x) for x in zip(*lines_held))
            line, word, place = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((number, doc, k1))
            first = np.zeros(len(k1), bool)
            first[order] = np.append(True, k1[order][1:] != k1[order][:-1])
            use = first[line]
            line, word, place = line[use], word[use], place[use]
            times = -(-counted[cell_of(word)].astype("int64") // long)
            mixed = mix(word ^ STEP)
            own = np.where(times > 1, mix(mixed + k1[line].view("uint64") % np.maximum(times, 1).astype("uint64") * STEP), mixed)
            group = own % np.uint64(groups)
            order = np.argsort((group << np.uint64(32)) | (mixed >> np.uint64(32)))
            line, group = line[order], group[order].astype("int32")
            columns = {"word": (mixed[order] >> np.uint64(32)).astype("uint32"), "k1": k1[line], "doc": doc[line], "line": number[line], "n": n[line], "place": place[order], "p0": p0[line], "p1": p1[line], "split": (times[order] > 1).astype("uint8")}
            cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            ends = np.append(cuts[1:], len(group))
            packed = [pa.array([pack(columns[c][a:b]) for a, b in zip(cuts, ends)], pa.binary()) for c in PACKED]
            return pa.RecordBatch.from_arrays([pa.array(group[cuts]), *packed], names=["group", *PACKED])

        for batch in slices(batches, TOGETHER):
            lines = Lines(batch.column(2), counted)
            if not len(lines.doc):
                continue
            use = lines.place < prefix_of(lines.n, similarity)[lines.line]
            lines_held.append((lines.k1, batch.column(0).to_numpy()[lines.doc], lines.number, lines.n.astype("int32"), *lines.parity()))
            held.append((lines.line[use] + base, lines.word[use], lines.place[use].astype("int32")))
            base += len(lines.doc)
            size += int(use.sum())
            if size >= GATHERED:
                yield dealt()
                lines_held, held, size, base = [], [], 0, 0
        if held:
            yield dealt()

    return map_arrow(rows, run, "group int, " + ", ".join(f"{c} binary" for c in PACKED))


def join_lists(x: dict[str, np.ndarray], similarity: float, kept: int) -> dict[str, np.ndarray]:
    """Of the sets of a group's postings, the pairs (b, a) with an earlier set that pass all filters.

    Each b keeps the ``kept`` most alike; ``more`` says that there were others, here or in other
    groups of a split list. A set of a split list without any pair has one row of a null a.
    """
    order = np.lexsort((x["line"], x["doc"], x["k1"]))
    new = np.append(True, x["k1"][order][1:] != x["k1"][order][:-1])
    first = order[new]
    turn = np.lexsort((x["k1"][first], x["line"][first], x["doc"][first]))  # sets are numbered as they come
    number = np.empty(len(first), "int64")
    number[turn] = np.arange(len(first))
    own = np.empty(len(order), "int64")
    own[order] = number[np.cumsum(new) - 1]
    sets = {c: x[c][first[turn]] for c in ("k1", "doc", "line", "n", "p0", "p1")}
    key = (x["word"].astype("uint64") << np.uint64(32)) | x["n"].astype("uint64")
    order = np.lexsort((own, key))
    key, own, place, split = key[order], own[order], x["place"][order].astype("int64"), x["split"][order]
    new = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))
    key, own, place, split = key[new], own[new], place[new], split[new]
    n = sets["n"].astype("int64")
    low = np.searchsorted(key, (key >> np.uint64(32) << np.uint64(32)) | np.ceil(similarity * n[own] - 1e-9).astype("uint64"))
    many = np.arange(len(key)) - low  # partners of no greater length
    upto = np.cumsum(many)
    best, more = np.empty(0, "uint64"), np.zeros(len(n), bool)
    more[own[split > 0]] = True

    def merge(best: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
        best = np.unique(np.concatenate([best, *found]))
        b = best >> np.uint64(40)
        over = np.arange(len(b)) - np.searchsorted(b, b) >= kept
        more[b[over].astype("int64")] = True
        return best[~over]

    found, size, start = [], 0, 0
    while start < len(key):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, side="right")))
        count = many[start:end]
        j = np.repeat(np.arange(start, end), count)
        i = np.arange(len(j)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[start:end], count)
        a, b = own[i], own[j]
        both = n[a] + n[b]
        least = least_common(both, similarity)
        use = np.minimum(place[i], place[j]) + np.minimum(n[a] - place[i], n[b] - place[j]) >= least
        a, b, both, least = a[use], b[use], both[use], least[use]
        unlike = np.bitwise_count(sets["p0"][a] ^ sets["p0"][b]).astype("int64") + np.bitwise_count(sets["p1"][a] ^ sets["p1"][b])
        use = both - unlike >= 2 * least
        a, b, unlike = a[use], b[use], unlike[use]
        later, earlier = np.maximum(a, b).astype("uint64"), np.minimum(a, b).astype("uint64")
        found.append((later << np.uint64(40)) | (unlike.astype("uint64") << np.uint64(32)) | earlier)
        size += len(a)
        if size > 8 * PAIRS:
            best, found, size = merge(best, found), [], 0
        start = end
    best = merge(best, found)
    b, a, unlike = (best >> np.uint64(40)).astype("int64"), (best & np.uint64(2**32 - 1)).astype("int64"), ((best >> np.uint64(32)) & np.uint64(255)).astype("int32")
    alone = np.setdiff1d(np.flatnonzero(more), b)
    return sets | {"b": np.append(b, alone), "a": np.append(a, np.full(len(alone), -1)), "unlike": np.append(unlike, np.zeros(len(alone), "int32")), "more": more[np.append(b, alone)]}


def candidates(packed: DataFrame, similarity: float, kept: int = KEPT) -> DataFrame:
    """b, a (keys of sets, b's first line after a's), their lines, unlike (bits of the sketches), more."""

    def join(table: pa.Table) -> pa.Table:
        f = join_lists({c: unpack(table.column(c), kind) for c, kind in PACKED.items()}, similarity, kept)
        none = f["a"] < 0
        a = np.maximum(f["a"], 0)
        columns = {"b": f["k1"][f["b"]], "b_doc": f["doc"][f["b"]], "b_line": f["line"][f["b"]]}
        columns = {c: pa.array(v) for c, v in columns.items()} | {c: pa.array(f[v][a], mask=none) for c, v in (("a", "k1"), ("a_doc", "doc"), ("a_line", "line"))}
        return pa.table(columns | {"unlike": pa.array(f["unlike"]), "more": pa.array(f["more"])})

    return group_arrow(packed, ["group"], join, "b long, b_doc long, b_line int, a long, a_doc long, a_line int, unlike int, more boolean")


def sets_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """k1 and the sorted set, as bytes, of the wanted lines (doc_id, line); broadcast if few documents have some."""
    by_doc = materialise(wanted.groupBy("doc_id").agg(F.collect_set("line").alias("lines")))
    few = is_small(by_doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TOGETHER):
            lines = Lines(batch.column(0))
            asked = [set(x) for x in batch.column(1).to_pylist()]
            ends = lines.start + lines.n
            use = [k for k, (d, number) in enumerate(zip(lines.doc.tolist(), lines.number.tolist())) if number in asked[d]]
            found = [np.sort(lines.word[lines.start[k] : ends[k]]).tobytes() for k in use]
            yield pa.RecordBatch.from_arrays([pa.array(lines.k1[use] if use else [], pa.int64()), pa.array(found, pa.binary())], names=["k1", "words"])

    return map_arrow(rows.join(F.broadcast(by_doc) if few else by_doc, "doc_id").select("text", "lines"), run, "k1 long, words binary")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """b of the pairs (b, a) whose sets are that similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hits = set()
            for b, x, y in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if b not in hits and matches(np.frombuffer(x, "uint64"), np.frombuffer(y, "uint64"), similarity):
                    hits.add(b)
            yield pa.RecordBatch.from_arrays([pa.array(list(hits), pa.int64())], names=["b"])

    both = pairs.join(sets.toDF("b", "own"), "b").join(sets.toDF("a", "other"), "a").select("b", "own", "other")
    return materialise(map_arrow(both, run, "b long").distinct())


def matches(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    return common(x, y) >= similarity / (1 + similarity) * (len(x) + len(y)) - 1e-9


def ask_all(rows: DataFrame, asked: list, counted: np.ndarray, similarity: float) -> DataFrame:
    """b of those of the asked sets (b, b_doc, b_line, words) that an earlier line of all documents matches.

    The asked travel to the lines; a task keeps no pairs, and asks no more of what it has found.
    """
    sets = [np.frombuffer(r["words"], "uint64") for r in asked]
    where = [np.array([r[c] for r in asked], "int64") for c in ("b_doc", "b_line", "b")]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    word = np.concatenate(sets)
    rank = np.minimum(counted[cell_of(word)], (1 << RANK_BITS) - 1).astype("int64")
    order = np.lexsort((word, rank, owner))
    place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    use = order[place < prefix_of(sizes, similarity)[owner]]
    use = use[np.argsort(word[use], kind="stable")]
    bit = mix(word ^ FACTOR) & np.uint64(127)
    sketch = [np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == side, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)), np.cumsum(sizes) - sizes) for side in (1, 0)]
    shared = rows.sparkSession.sparkContext.broadcast((sets, where, sizes, sketch, word[use], owner[use], counted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, where, sizes, sketch, word, owner, counted = shared.value
        done = np.zeros(len(sets), bool)
        for batch in slices(batches, TOGETHER):
            lines = Lines(batch.column(2), counted)
            use = np.flatnonzero(lines.place < prefix_of(lines.n, similarity)[lines.line])
            low, high = (np.searchsorted(word, lines.word[use], side=s) for s in ("left", "right"))
            hit = np.repeat(np.arange(len(use)), high - low)
            line = lines.line[use][hit]
            other = owner[np.arange(len(hit)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[hit]]
            both = lines.n[line] + sizes[other]
            bits = sum(np.bitwise_count(x[line] ^ y[other]).astype("int64") for x, y in zip(lines.parity(), sketch))
            fits = (both - bits >= 2 * least_common(both, similarity)) & ~done[other]
            line, other = line[fits], other[fits]
            spot = (batch.column(0).to_numpy()[lines.doc[line]], lines.number[line].astype("int64"), lines.k1[line])
            earlier, tie = np.zeros(len(line), bool), np.ones(len(line), bool)
            for x, y in zip(spot, (w[other] for w in where)):
                earlier |= tie & (x < y)
                tie &= x == y
            for pair in np.unique((line[earlier] << 32) | other[earlier]):
                k, b = int(pair) >> 32, int(pair) & (2**32 - 1)
                if not done[b]:
                    done[b] = matches(np.sort(lines.word[lines.start[k] : lines.start[k] + lines.n[k]]), sets[b], similarity)
        yield pa.RecordBatch.from_arrays([pa.array(where[2][done])], names=["b"])

    return map_arrow(rows, run, "b long")


def later_sets(rows: DataFrame, counted: np.ndarray, groups: int, similarity: float, kept: int = KEPT, long: int = LONG) -> DataFrame:
    """b (k1) of every set of which an earlier set is that similar, but not equal."""
    found = materialise(candidates(postings(rows, counted, groups, similarity, long), similarity, kept))
    free_shuffles(rows.sparkSession)
    lines = found.select(F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line")).union(found.where("a is not null").select("a_doc", "a_line")).distinct()
    sets = materialise(sets_of(rows, lines).dropDuplicates(["k1"]))
    alike = Window.partitionBy("b").orderBy("unlike", "a")
    pairs = materialise(found.where("a is not null").groupBy("b", "a").agg(F.min("unlike").alias("unlike")).withColumn("turn", F.row_number().over(alike)))
    done = similar(pairs.where(F.col("turn") <= FIRST), sets, similarity)
    rest = similar(attach(pairs.where(F.col("turn") > FIRST), done, ["b"], "left_anti"), sets, similarity)
    done = done.union(rest)
    left = attach(found.where("more").groupBy("b").agg(F.min("b_doc").alias("b_doc"), F.min("b_line").alias("b_line")), done, ["b"], "left_anti")
    left = materialise(left.join(sets.toDF("b", "words"), "b"))
    blocks = -(-left.count() // ASKED)
    for k in range(blocks):
        asked = left.where(F.pmod(F.xxhash64("b"), F.lit(blocks)) == k).collect()  # about ASKED rows
        if asked:
            done = done.union(materialise(ask_all(rows, asked, counted, similarity).distinct()))
    done = materialise(done.distinct())
    forget(found, sets, pairs, left)
    return done


def later_lines(documents: DataFrame, similarity: float = SIMILARITY, kept: int = KEPT, long: int = LONG) -> DataFrame:
    """doc_id, version, line of every line that an earlier line matches."""
    rows = named(documents)
    surveyed = materialise(survey(rows))
    lines = surveyed.where("part is null").select("doc_id", "version", "line", "k1", "k2", "n")
    place = F.struct("doc_id", "line", "version")
    again = materialise(lines.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").select("k1", "k2", "first"))
    copies = attach(lines, again, ["k1", "k2"]).where(place != F.col("first")).select("doc_id", "version", "line")
    amount = lines.agg(F.sum(F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1)).first()[0] or 0
    if not amount:
        return copies
    done = later_sets(rows, total_counts(surveyed), max(1, math.ceil(amount / GROUP)), similarity, kept, long)
    return copies.union(attach(lines, done.withColumnRenamed("b", "k1"), ["k1"], "left_semi").select("doc_id", "version", "line")).distinct()


def dedup(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All rows and columns of documents; text without the lines that go, and the columns
    __lines (of the text) and __removed (their numbers, in order)."""
    gone = materialise(later_lines(documents, similarity).groupBy(F.col("doc_id").alias("__doc"), F.col("version").alias("__version")).agg(F.sort_array(F.collect_set("line")).alias("__removed")))
    text = F.col("text").cast("string")
    same = (F.col("doc_id").cast("long") == F.col("__doc")) & (F.xxhash64(text) == F.col("__version"))
    joined = attach(documents, gone, same, "left").drop("__doc", "__version")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, k: ~F.array_contains("__removed", k)), "\n")
    cut = F.when(F.col("__removed").isNull(), text).otherwise(kept).cast(documents.schema["text"].dataType)
    return joined.select(*[cut.alias(c) if c == "text" else F.col(f"`{c}`") for c in documents.columns], F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).alias("__lines"), F.coalesce("__removed", F.array().cast("array<int>")).alias("__removed"))


def report(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0, comma-joined) and the text that stays."""
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    removed: Column = F.array_join(F.transform("__removed", lambda k: k.cast("string")), ",")
    return dedup(plain, similarity).select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.size("__removed").cast("long").alias("n_removed"), removed.alias("removed"), "text")


def without_repeated_lines(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All rows and columns; text without the lines that an earlier line matches."""
    return dedup(documents, similarity).drop("__lines", "__removed")

"""Exact n-gram Jaccard join by set-relation skipping (operator 3).

A document's set is the set of its distinct n-word shingles, as 64-bit hashes. Two
sets link at Jaccard ``percent`` / 100 or more, in whole numbers:
100 * |A & B| >= percent * |A | B|. Rows with one set are one node, so copies are
never compared.

Any two linking sets share an element of their prefixes: the first
|A| - ceil(t * |A|) + 1 elements in any common order. The order is rarest
first: element counts over all documents are kept in a table of bounded size, and
ties go by hash. An inverted index from prefix elements to sets would give all
candidates; relations between sets let most of it be skipped:

* *Answers from similar sets.* Sets that share a band of minimum hashes are
  compared with one representative of the band, their head, and where they link the
  differing elements are kept (``deltas``). From then on a set's answers follow from
  its head's: |A & B| is the heads' overlap, computed once for two heads, put right
  by the differing elements alone. Sets of members are never read again.
* *Answers from components.* The links found join sets into components; for the
  components of the result a pair inside one is answered and never enumerated.
* *Skipped lists.* An index list whose sets all lie in one component can only
  repeat known answers. Per element the smallest and largest component are
  aggregated, pre-combined in each task; equal ends skip the list whole.
* *Skipped blocks.* A list of more than BLOCK sets is ordered into cells by set size and
  by the element's position in the set; neighbouring cells make up blocks of about BLOCK
  sets, and large cells several. Of each only bounds are known: least and largest size, most elements from
  the position on, least and largest component. Blocks whose bounds admit no link,
  or that lie in one component, are skipped with all their pairs
  before any set is looked at (``run_pairs``).
* *Skipped pairs.* In the block pairs that remain, pairs of one component, pairs whose sizes
  cannot reach the threshold, and pairs that share an element at positions i and
  j with min(|A| - i, |B| - j) below the overlap needed are skipped.
* *Bound of the difference.* The difference of two sets is bounded from below by the
  difference of their parity vectors (one bit per hash bucket, a hundredth of the
  set's size), computed for whole blocks at once; only pairs within the allowed
  difference are counted.

Each pair of different sets that could link is so either inside a component,
ruled out by a bound, or counted element by element. Nothing is sampled or
capped; the result is exact up to collisions of 64-bit hashes.

Scale: texts are hashed twice, and once more for the rows whose sets are compared;
sets of other rows never travel. No list is gathered in one task, and no join goes by
element alone. Only tables of bounded size (element counts, bit tables) reach the
driver, put together in pieces; they grow with the data up to MOST_COUNTERS and
MOST_BITS. Beyond the first, only the more frequent elements are told from each other, which
makes lists longer; beyond the second, an exact semi-join does what the bits did.

Edges: null or word-less text is the empty set, which links with nothing; texts
below n words have one shingle of all their words. A row with null id has the
component of its set's other rows, else null. Repeated rows share their node. An
empty table gives an empty result. Columns besides id and text are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import common

#: Element counters and bits of tables, by the size of the data, at most so many.
LEAST_COUNTERS, MOST_COUNTERS = 1 << 20, 1 << 24
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Pieces in which such tables are put together.
PARTS = 64
BINS = 32
PER_BAND = 2
#: Nodes that a task remembers; about how many bytes of words, with what Python adds to each, and the longest of these.
NODE_CACHE, CACHE_BYTES, WORD_BYTES, CACHED_WORD = 400_000, 32_000_000, 150, 64
#: Rows of an index list that are compared with as many others in one step.
BLOCK = 256
#: Size classes of cells: so many to a factor of 1.25. Position classes: so many to the whole set.
SIZE_STEPS, POSITION_STEPS = 8, 40
#: Groups up to this size are paired together with others.
SMALL = 24
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class Hasher(dict):
    """Hashes of words, kept up to a bound of bytes; long words are hashed anew."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_WORD:
            self.held += WORD_BYTES + len(word)
            if self.held > CACHE_BYTES:
                self.clear()
                self.held = WORD_BYTES + len(word)
            self[word] = value
        return value

    def shingles(self, text: str | None, n: int) -> np.ndarray:
        """Sorted distinct shingle hashes of a text."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        k = min(n, len(h))
        last = len(h) - k + 1
        out = np.zeros(last, np.uint64)
        for i in range(k):
            out = (out ^ h[i : last + i]) * MIX[i % len(MIX)]
            out ^= out >> np.uint64(29)
        return np.unique(out)


def node_of(s: np.ndarray) -> int | None:
    """One number for a whole set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else None


def band_keys(s: np.ndarray) -> np.ndarray:
    """Keys of the bands of minimum hashes: the smallest hash in each of BINS ranges, or the next."""
    low = s[np.searchsorted(s, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - int(math.log2(BINS)))) % len(s)]
    key = np.arange(BINS // PER_BAND, dtype=np.uint64) * MIX[0]
    for i in range(PER_BAND):
        key = (key ^ low[i::PER_BAND]) * MIX[i + 1]
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def parity(s: np.ndarray) -> bytes:
    """Parity of the number of elements in each of 2**k >= |s| buckets, 256 at least."""
    width = max(256, 1 << (len(s) - 1).bit_length())
    return np.packbits((np.bincount(((s >> np.uint64(7)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of parity bytes over half as many buckets as often as needed."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def allowed(total: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that two sets of so many elements together need."""
    return -((-percent * total) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n + (-percent * n) // 100 + 1


# ---------------------------------------------------------------- tables of fixed size


def packed(values: np.ndarray) -> bytes:
    """Small counts or bits, compressed."""
    return zlib.compress((values.astype(np.uint8) if values.max(initial=0) < 256 else values).tobytes(), 1)


def unpacked(piece: bytes, size: int, kind: type) -> np.ndarray:
    raw = zlib.decompress(piece)
    return np.frombuffer(raw, np.uint8 if len(raw) == size else kind).astype(kind)


def joined(pieces: DataFrame, size: int, kind: type, join: Callable) -> np.ndarray:
    """One array of ``size`` items from (part, piece): pieces of a part are joined in its task."""
    step = size // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = unpacked(value.as_buffer(), step, kind)
                total[part] = join(total[part], one) if part in total else one
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([packed(t) for t in total.values()], pa.binary())], ["part", "piece"])

    out = np.zeros(size, kind)
    # PARTS rows, or one more for each part that two tasks had: the size is bounded
    for part, piece in pieces.select("part", "piece").repartition(PARTS, "part").mapInArrow(run, "part int, piece binary").collect():
        out[part * step : (part + 1) * step] = unpacked(piece, step, kind)
    return out


def power_of_two(least: int, wanted: int, most: int) -> int:
    return min(max(least, 1 << max(wanted - 1, 0).bit_length()), most)


def bit_table(keys: DataFrame) -> np.ndarray:
    """A table of bits, 32 a key or MOST_BITS in all, in which two bits of every long in a column of a stored table are set."""
    bits = power_of_two(LEAST_BITS, 32 * keys.count(), MOST_BITS)
    width = bits // PARTS

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_slots(batch.column(0).to_numpy(zero_copy_only=False), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32))], ["part", "slot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags: dict[int, np.ndarray] = {}
        for batch in batches:
            part, slot = (batch.column(c).to_numpy() for c in ("part", "slot"))
            for p in np.unique(part).tolist():
                flags.setdefault(p, np.zeros(width, np.uint8))[slot[part == p]] = 1
        for p, f in flags.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([packed(np.packbits(f))], pa.binary())], ["part", "piece"])

    dealt = keys.mapInArrow(slots, "part int, slot int").distinct().repartition(PARTS, "part")
    return joined(dealt.mapInArrow(run, "part int, piece binary"), bits // 8, np.uint8, np.bitwise_or)


def _slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = keys.astype(np.int64).view(np.uint64)
    return tuple(((x * m >> np.uint64(33)) & np.uint64(bits - 1)).astype(np.int64) for m in MIX[2:4])


def has(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for at in _slots(keys, 8 * len(table)):
        found &= (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
    return found


# ---------------------------------------------------------------- passes over texts


def describe(docs: DataFrame, n: int, counters: int) -> DataFrame:
    """doc_id, text_h, node, size of each row; bands and bits once per task and node; at a task's end its element counts in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, counts = Hasher(), set(), np.zeros(counters, np.int32)
        names = ["doc_id", "text_h", "node", "size", "bands", "bits", "part", "piece"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary()]
        for whole in batches:
            for batch in common.slices(whole, "text"):
                rows, slots = [], []
                for i, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_h", "text")), strict=True):
                    s = hashes.shingles(text, n)
                    node = node_of(s)
                    new = node is not None and node not in seen
                    if new:
                        seen.add(node)
                    slots.append(s)
                    rows.append((i, h, node, len(s), band_keys(s) if new else None, parity(s) if new else None, None, None))
                np.add.at(counts, (np.concatenate(slots) & np.uint64(counters - 1)).astype(np.int64), 1)
                if len(seen) > NODE_CACHE:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if counts.any():
            columns = [[None] * PARTS] * 6 + [list(range(PARTS)), [packed(p) for p in counts.reshape(PARTS, -1)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.mapInArrow(run, "doc_id long, text_h long, node long, size long, bands array<long>, bits binary, part int, piece binary")


def prefixes(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """node, size and prefix elements, rarest first; once per task and node.

    Counts are told apart by eighths of a power of two; elements alike in that go by hash.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(np.minimum(np.round(8 * np.log2(1.0 + counts)), 255).astype(np.uint8))  # MOST_COUNTERS bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, table = Hasher(), set(), shipped.value
        for whole in batches:
            for batch in common.slices(whole, "text"):
                rows = []
                for text in batch.column("text").to_pylist():
                    s = hashes.shingles(text, n)
                    node = node_of(s)
                    if node is None or node in seen:
                        continue
                    seen.add(node)
                    often = table[(s & np.uint64(len(table) - 1)).astype(np.int64)]
                    first = s[np.argsort(often, kind="stable")[: prefix_size(len(s), percent)]]
                    rows.append((node, len(s), first.view(np.int64)))
                if len(seen) > NODE_CACHE:
                    seen.clear()
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["node", "size", "prefix"]
                    )

    return docs.select("text").mapInArrow(run, "node long, size long, prefix array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node and elements of the wanted (node, doc_id); other rows are passed over by a bit table of ids."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(wanted.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"))))  # MOST_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, bits = Hasher(), set(), table.value
        for whole in batches:
            ids = np.array([i or 0 for i in whole.column("doc_id").to_pylist()], np.int64)
            chosen = whole.filter(pa.array(has(bits, ids)))
            for batch in common.slices(chosen, "text"):
                rows = []
                for text in batch.column("text").to_pylist():
                    s = hashes.shingles(text, n)
                    node = node_of(s)
                    if node is not None and node not in seen:
                        seen.add(node)
                        rows.append((node, s.view(np.int64)))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["node", "elements"]
                    )

    found = docs.mapInArrow(run, "node long, elements array<long>").join(wanted.select(F.col("node").alias("want")), F.col("node") == F.col("want"), "left_semi")
    return common.stored(found.dropDuplicates(["node"]), "sets")


# ---------------------------------------------------------------- comparisons


def _close_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """The (x, y) whose parity vectors and sizes leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("nx", "ny"))
            need = allowed(nx + ny, percent)
            keep = np.minimum(nx, ny) >= need
            bx, by = batch.column("bx"), batch.column("by")
            for i in np.flatnonzero(keep).tolist():
                a, b = (np.frombuffer(c[i].as_buffer(), np.uint8)[None, :] for c in (bx, by))
                size = min(a.shape[1], b.shape[1])
                apart = int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())
                keep[i] = apart <= nx[i] + ny[i] - 2 * need[i]
            yield batch.select(["x", "y"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "x long, y long")


def _links_at(both: Column, total: Column, percent: int) -> Column:
    return 100 * both >= percent * (total - both)


def counted(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (x, y) that link, by their elements, with those of y that x lacks (minus) and those of x that y lacks (plus)."""
    left, right = sets.select(F.col("node").alias("x"), F.col("elements").alias("ex")), sets.select(F.col("node").alias("y"), F.col("elements").alias("ey"))
    apart = pairs.join(left, "x").join(right, "y").select("x", "y", F.size("ex").alias("nx"), F.size("ey").alias("ny"), F.array_except("ey", "ex").alias("minus"), F.array_except("ex", "ey").alias("plus"))
    return apart.where(_links_at(F.col("ny") - F.size("minus"), F.col("nx") + F.col("ny"), percent)).select("x", "y", "minus", "plus")


def derived(pairs: DataFrame, deltas: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """The (x, y) that link, from the answers of their heads.

    A set is its head less ``minus`` and with ``plus``; a set without a head is its own. The overlap of
    two sets is that of their heads, less what x or y lacks of it, and what plus adds to it: all
    sizes of intersections with a difference, save one for each two heads.
    """
    empty = F.array().cast("array<long>")

    def member(side: str) -> DataFrame:
        return deltas.select(F.col("node").alias(side), F.col("head").alias("h" + side), F.col("minus").alias("m" + side), F.col("plus").alias("p" + side))

    def filled(side: str) -> list[Column]:
        return [F.coalesce("h" + side, side).alias("h" + side), *(F.coalesce(c + side, empty).alias(c + side) for c in "mp")]

    known = common.stored(pairs.join(member("x"), "x", "left").join(member("y"), "y", "left").select("x", "y", *filled("x"), *filled("y")), "members")
    apart = known.where("hx <> hy")
    ends = apart.select(F.col("hx").alias("node")).union(apart.select(F.col("hy").alias("node"))).distinct()
    sets = sets_of(docs, common.stored(nodes.select("node", "doc_id").join(ends, "node"), "heads"), n)
    two = apart.select("hx", "hy").distinct()
    of = lambda side: sets.select(F.col("node").alias("h" + side), F.col("elements").alias("e" + side))
    heads = common.stored(two.join(of("x"), "hx").join(of("y"), "hy").select("hx", "hy", F.size(F.array_intersect("ex", "ey")).alias("both")), "head_overlaps")

    def against(side: str, other: str) -> DataFrame:
        """Of each member that differs from its head: how much of the differences the other head has."""
        rows = apart.where(F.size("m" + side) + F.size("p" + side) > 0).select(side, "h" + other, "m" + side, "p" + side).dropDuplicates([side, "h" + other])
        sizes = (F.size(F.array_intersect(c + side, "e" + other)).alias(c + side + "h") for c in "mp")
        return common.stored(rows.join(of(other), "h" + other).select(side, "h" + other, *sizes), "against")

    size = nodes.select(F.col("node").alias("at"), F.col("size").alias("n"))
    common_part = lambda a, b: F.size(F.array_intersect(a, b))
    same = known.where("hx = hy").join(size.withColumnRenamed("at", "hx"), "hx")
    same = same.withColumn("both", F.col("n") - F.size("mx") - F.size("my") + common_part("mx", "my") + common_part("px", "py"))
    across = apart.join(heads, ["hx", "hy"]).join(against("x", "y"), ["x", "hy"], "left").join(against("y", "x"), ["y", "hx"], "left")
    part = lambda c: F.coalesce(c, F.lit(0))
    across = across.withColumn(
        "both",
        F.col("both") - part("mxh") - part("myh") + part("pxh") + part("pyh")
        + common_part("mx", "my") - common_part("px", "my") - common_part("py", "mx") + common_part("px", "py"),
    )
    found = same.select("x", "y", "both").unionByName(across.select("x", "y", "both"))
    sized = found.join(size.select(F.col("at").alias("x"), F.col("n").alias("nx")), "x").join(size.select(F.col("at").alias("y"), F.col("n").alias("ny")), "y")
    return common.stored(sized.where(_links_at(F.col("both"), F.col("nx") + F.col("ny"), percent)).select("x", "y"), "links")


# ---------------------------------------------------------------- blocks of long lists


CELL = ["element", "size_class", "position_class"]


def cells_of(entries: DataFrame) -> DataFrame:
    """entries (element, node, component, position, size) with the cell each belongs to: classes of size and position."""
    size_class = F.floor(F.log("size") * F.lit(SIZE_STEPS / math.log(1.25))).cast("int")
    position_class = F.least(F.floor(F.col("position") * POSITION_STEPS / F.col("size")), F.lit(POSITION_STEPS - 1)).cast("int")
    return entries.withColumns({"size_class": size_class, "position_class": position_class})


def runs_of(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, runs) of long lists: neighbouring cells, ordered by size and position, that have about BLOCK sets together.

    cells: the run of each cell. runs: bounds of each run and how many blocks it has; more than one only if it is one
    cell above BLOCK. A list has no more cells than there are classes, whatever its length.
    """
    counted = cells_of(entries).groupBy(*CELL).agg(
        F.count("*").alias("n"),
        F.min("size").alias("least"),
        F.max("size").alias("most"),
        F.max(F.col("size") - F.col("position")).alias("room"),
        F.min("component").alias("low"),
        F.max("component").alias("high"),
    )
    before = F.sum("n").over(Window.partitionBy("element").orderBy("size_class", "position_class")) - F.col("n")
    run = F.when(F.col("n") > BLOCK, 2 * F.col("before") + 1).otherwise(2 * BLOCK * F.floor(F.col("before") / BLOCK))
    cells = common.stored(counted.withColumn("before", before).withColumn("run", run.cast("long")).drop("before"), "cells")
    blocks = F.when(F.max("n") > BLOCK, F.ceil(F.max("n") / BLOCK)).otherwise(1).cast("int").alias("blocks")
    bounds = [f(c).alias(c) for f, c in ((F.min, "least"), (F.max, "most"), (F.max, "room"), (F.min, "low"), (F.max, "high"))]
    return cells.select(*CELL, "run"), common.stored(cells.groupBy("element", "run").agg(blocks, *bounds), "runs")


def run_pairs(runs: DataFrame, percent: int, skip: bool = True) -> DataFrame:
    """Per run of a long list (element, run) its blocks and the runs with which it is compared.

    Two runs are left out, with all pairs of their blocks, if their bounds of size or position admit no link or
    if both lie in one component. Without ``skip`` every two runs of a list are there.
    """
    others = runs.select("element", *(F.col(c).alias("o_" + c) for c in runs.columns if c != "element"))
    need = lambda a, b: F.ceil(percent * (a + b) / F.lit(100.0 + percent) - 1e-9)
    small, large = F.least("most", "o_most"), F.greatest("least", "o_least")
    possible = (
        ((small >= large) | (need(small, large) <= small))
        & (need(F.col("least"), F.col("o_least")) <= F.least("room", "o_room"))
        & ~((F.col("low") == F.col("high")) & (F.col("o_low") == F.col("o_high")) & (F.col("low") == F.col("o_low")))
    )
    both = runs.join(others, "element")
    both = both.where(possible) if skip else both
    partner = F.struct(F.col("o_run").alias("run"), F.col("o_blocks").alias("blocks"))
    return common.stored(both.groupBy("element", "run").agg(F.first("blocks").alias("blocks"), F.collect_list(partner).alias("partners")), "partners")


def dealt_blocks(entries: DataFrame, cells: DataFrame, partners: DataFrame) -> DataFrame:
    """Rows of long lists, one for each block pair that is not skipped: a and b are the blocks, block the row's own."""
    compared = common.stored(cells.join(partners, ["element", "run"]), "compared")
    rows = cells_of(entries).join(compared, CELL)
    own = F.col("run") * (1 << 20) + F.pmod(F.xxhash64("node"), F.col("blocks"))
    rows = rows.withColumn("block", own).withColumn("partner", F.explode("partners"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("partner.blocks") - 1)))
    other = F.col("partner.run") * (1 << 20) + F.col("k")
    return rows.withColumn("a", F.least("block", other)).withColumn("b", F.greatest("block", other)).select(*entries.columns, "a", "b", "block")


def long_list_rows(entries: DataFrame, percent: int, skip: bool = True) -> DataFrame:
    cells, runs = runs_of(entries)
    return dealt_blocks(entries, cells, run_pairs(runs, percent, skip))


def _group_starts(g: dict[str, np.ndarray]) -> np.ndarray:
    key = [g[c] for c in ("element", "a", "b")]
    return np.r_[0, np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1]


def _pairs_of(g: dict[str, np.ndarray], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of whole groups that stay possible, by their bits too where the rows have any.

    Small groups are paired all at once, a row with those 1, 2, … places after it;
    larger ones, which are blocks of bounded size, each as a matrix.
    """
    total = len(g["node"])
    if total < 2:
        return
    starts = _group_starts(g)
    sizes = np.diff(np.r_[starts, total])
    width = np.fromiter(map(len, g["bits"]), np.int64, total) if "bits" in g else np.zeros(total, np.int64)
    place, tables = np.empty(total, np.int64), {}
    for w in np.unique(width[width > 0]).tolist():
        mine = np.flatnonzero(width == w)
        place[mine] = np.arange(len(mine))
        tables[w] = np.frombuffer(b"".join(g["bits"][mine]), np.uint8).reshape(len(mine), w)
    n, c, k = g["size"], g["component"], g["node"]
    room = n - g["position"]

    def close(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        need = allowed(n[i] + n[j], percent)
        ok = (c[i] != c[j]) & (np.minimum(room[i], room[j]) >= need)
        i, j, need = i[ok], j[ok], need[ok]
        if "bits" not in g:
            return i, j
        keep = np.zeros(len(i), bool)
        both = np.minimum(width[i], width[j]) << 32 | np.maximum(width[i], width[j])
        for code in np.unique(both).tolist():
            w = code >> 32
            chosen = np.flatnonzero(both == code)
            for at in range(0, len(chosen), 8192):
                some = chosen[at : at + 8192]
                sides = []
                for side in (i[some], j[some]):
                    out = np.empty((len(some), w), np.uint8)
                    for v in np.unique(width[side]).tolist():
                        which = np.flatnonzero(width[side] == v)
                        out[which] = folded(tables[v][place[side[which]]], w)
                    sides.append(out.view(np.uint64))
                apart = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1, dtype=np.int64)
                keep[some] = apart <= n[i[some]] + n[j[some]] - 2 * need[some]
        return i[keep], j[keep]

    found = []
    group = np.repeat(np.arange(len(starts)), np.where(sizes <= SMALL, sizes, 0))
    small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    for step in range(1, min(SMALL, int(sizes[sizes <= SMALL].max(initial=0)))):
        at = np.flatnonzero(group[step:] == group[:-step])
        if not len(at):
            break
        found.append(close(small[at], small[at + step]))
    for s, m in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        one, two = np.triu_indices(m, 1)
        if g["a"][s] != g["b"][s]:
            across = g["block"][s + one] != g["block"][s + two]
            one, two = one[across], two[across]
        found.append(close(s + one, s + two))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    if len(i):
        pairs = np.unique(np.stack([np.maximum(k[i], k[j]), np.minimum(k[i], k[j])]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["x", "y"])


def _list_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of the block pairs of index lists; see the module's text.

    ``rows`` (element, a, b, block, node, size, component, position, maybe bits) are brought together by
    (element, a, b); block tells which of the two blocks a row is of.
    """
    has_bits = "bits" in rows.columns

    names = ["element", "a", "b", "block", "node", "size", "component", "position"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if has_bits:
                now["bits"] = np.array([*batch.column("bits").to_pylist(), None], object)[:-1]
            if held is not None:
                now = {c: np.concatenate([held[c], now[c]]) for c in now}
            cut = _group_starts(now)[-1]  # the last group may go on
            yield from _pairs_of({c: v[:cut] for c, v in now.items()}, percent)
            held = {c: v[cut:] for c, v in now.items()}
        if held is not None:
            yield from _pairs_of(held, percent)

    dealt = rows.repartition("element", "a", "b").sortWithinPartitions("element", "a", "b")
    return dealt.mapInArrow(run, "x long, y long").distinct()


# ---------------------------------------------------------------- the join


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_h"))


def jaccard_links(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, components) of (doc_id, text, text_h).

    rows: doc_id, text_h, node, size of each row. nodes: node, size, bits, doc_id (the smallest).
    components: node, component of each node that links to another.
    """
    rows, nodes, links = _links(docs, n, percent, skip=True)
    return rows, nodes, common.connected_components(links)


def _links(docs: DataFrame, n: int, percent: int, skip: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows and nodes as above, and links (src, dst) of nodes.

    With ``skip``, as many links as the components need: pairs that one component answers
    are left out. Without, every link, once.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = power_of_two(LEAST_COUNTERS, size // 128, MOST_COUNTERS)
    rows = common.stored(describe(docs, n, counters), "described")
    distinct = rows.where("bits is not null").select("node", "size", "bits", "bands")
    nodes = common.stored(
        distinct.dropDuplicates(["node"]).join(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "node"), "nodes"
    )
    bits = nodes.select("node", "bits")

    def beside(pairs: DataFrame) -> DataFrame:
        x = nodes.select(F.col("node").alias("x"), F.col("size").alias("nx"), F.col("bits").alias("bx"))
        y = nodes.select(F.col("node").alias("y"), F.col("size").alias("ny"), F.col("bits").alias("by"))
        return pairs.join(x, "x").join(y, "y").select("x", "y", "nx", "ny", "bx", "by")

    # similar sets against the representatives of their bands
    bands = common.stored(nodes.select("node", F.explode("bands").alias("band")), "bands")
    heads = common.stored(bands.groupBy("band").agg(F.min("node").alias("y"), F.max("node").alias("z")).where("y <> z").select("band", "y"), "heads")
    star = bands.join(heads, "band").where("node <> y").select(F.col("node").alias("x"), "y").distinct()
    star = common.stored(_close_pairs(beside(star), percent), "close")
    ends = star.select(F.col("x").alias("node")).union(star.select(F.col("y").alias("node"))).distinct()
    sets = sets_of(docs, common.stored(nodes.select("node", "doc_id").join(ends, "node"), "wanted"), n)
    first = common.stored(counted(star, sets, percent), "first")
    deltas = common.stored(
        first.groupBy(F.col("x").alias("node")).agg(F.min(F.struct(F.col("y").alias("head"), "minus", "plus")).alias("d")).select("node", "d.*"), "deltas"
    )
    known = common.stored(common.connected_components(first.where(F.lit(skip)).select(F.col("x").alias("src"), F.col("y").alias("dst"))), "known")

    # the index, without lists of one component
    pieces = rows.where("piece is not null").select("part", "piece")
    counts = joined(pieces, counters, np.int32, lambda a, b: np.minimum(a.astype(np.int64) + b, 2**31 - 1).astype(np.int32))
    index = common.stored(
        prefixes(docs, n, percent, counts).join(known, "node", "left").select("node", "size", F.coalesce("component", "node").alias("component"), "prefix"),
        "index",
    )
    lists = index.select("component", F.explode("prefix").alias("element")).groupBy("element")
    mixed = common.stored(
        lists.agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("length")).where("low <> high").select("element", "length"),
        "mixed",
    )
    # tables of MOST_BITS at most
    tables = docs.sparkSession.sparkContext.broadcast((bit_table(mixed.select("element")), bit_table(mixed.where(F.col("length") > BLOCK).select("element"))))

    def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The index entries whose element may be of a list that remains, and whether that may be a long one."""
        flags, longer = tables.value
        for batch in batches:
            prefix = batch.column("prefix")
            sizes = prefix.value_lengths().to_numpy(zero_copy_only=False)
            element = prefix.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(element)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = has(flags, element)
            take = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays(
                [pa.array(element[keep]), *(batch.column(c).take(take) for c in ("node", "component", "size")), pa.array(place[keep].astype(np.int64)), pa.array(has(longer, element[keep]))],
                ["element", "node", "component", "size", "position", "longer"],
            )

    entries = index.select("node", "component", "size", "prefix").mapInArrow(live, "element long, node long, component long, size long, position long, longer boolean")
    if 8 * len(tables.value[0]) >= MOST_BITS:  # the bits let many other elements through
        entries = entries.join(mixed.select("element"), "element", "left_semi")
    entries = common.stored(entries.dropDuplicates(["element", "node"]), "entries")
    short = entries.where("not longer").drop("longer").select("*", *(F.lit(0).cast("long").alias(c) for c in ("a", "b", "block")))
    long_lists = entries.where("longer").drop("longer")
    # blocks of long lists bring their bits along, so that no pair leaves them that bits rule out; short lists have few pairs
    columns = ["element", "a", "b", "block", "node", "size", "component", "position"]
    few = common.stored(_list_pairs(short.select(*columns), percent), "few")
    many = _list_pairs(long_list_rows(long_lists, percent).join(bits, "node").select(*columns, "bits"), percent)
    pairs = common.stored(_close_pairs(beside(few), percent).unionByName(many).distinct(), "candidates")
    second = derived(pairs, deltas, docs, nodes, n, percent)
    links = (first.select("x", "y").unionByName(second) if skip else second).select(F.col("x").alias("src"), F.col("y").alias("dst"))
    return rows.where("piece is null"), nodes, links


def jaccard_link_counts(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and n_links (the other rows that its set links with) of every row.

    Pairs inside components are compared too, so that time grows with the number of
    close pairs. Copies are not compared: each counts for its node.
    """
    rows, _, links = _links(_texts(docs, id_col, text_col), n, percent, skip=False)
    links = common.stored(links, "all_links")
    copies = common.stored(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies")), "copies")
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    beside = both.join(copies, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.sum("copies").alias("beside"))
    total = (F.col("copies") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links")
    counts = common.stored(copies.join(beside, "node", "left").select("node", total), "link_counts")
    return rows.join(counts, "node", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _placed(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """rows of jaccard_links, and (node, root, doc_id): the smallest node that each node reaches and its own smallest id."""
    rows, nodes, components = jaccard_links(docs, n, percent)
    return rows, common.stored(nodes.select("node", "doc_id").join(components, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("root")), "placed")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) of every row."""
    rows, placed = _placed(_texts(docs, id_col, text_col), n, percent)
    least = common.stored(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    final = common.stored(placed.join(least, "root").select("node", "component_id"), "final")
    return rows.join(final, "node", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_one_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with the columns of docs: the one with the smallest id, then the smallest hash of its text.

    Ids need not be unique: rows are told apart by id and text, so that an unlike text which shares an id
    stays. A null id comes after all others. Of rows alike in id and text one stays. Rows without words are in no component and all stay.
    """
    rows, placed = _placed(_texts(docs, id_col, text_col), n, percent)
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_h")
    ranked = rows.where("node is not null").join(placed.select("node", "root"), "node").select("root", F.col("doc_id").alias("id"), "text_h")
    ranked = common.stored(ranked, "ranked")
    first = common.stored(ranked.groupBy("root").agg(F.min(rank).alias("first")), "firsts")
    told = [F.col("id").alias("__id"), F.col("text_h").alias("__h")]
    gone = ranked.join(first, "root").where(rank != F.col("first")).select(*told).distinct()
    again = common.stored(ranked.groupBy(*told).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    match = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__h"))
    left = docs.join(common.stored(gone, "gone"), match, "left_anti")
    if again.isEmpty():
        return left
    alike = left.join(again, match, "left_semi").withColumns({"__id": F.col(id_col), "__h": F.xxhash64(text_col)}).dropDuplicates(["__id", "__h"])
    return left.join(again, match, "left_anti").unionByName(alike.drop("__id", "__h"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles have Jaccard 0.8 or more."""
    return jaccard_components(common.table(spark, sf_dir, "documents"))


def op3_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents that each document links with."""
    return jaccard_link_counts(common.table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w
  from documents),
g as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end g from w),
n as (select doc_id, len(g) n from g),
e as (select doc_id, unnest(g) x from g),
c as (select a.doc_id a, b.doc_id b, count(*) o from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * o >= 80 * (na.n + nb.n - o)),
s as (select a, b from l union select b, a from l),
r(a, b) as (select doc_id, doc_id from n union select r.a, s.b from r join s on r.b = s.a)
select n.doc_id, n.n::bigint n_shingles, min(r.b) component_id from n join r on r.a = n.doc_id group by all
"""

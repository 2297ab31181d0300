"""Document fingerprints from prefix polynomial hashes (operator 8).

A text's prefix array holds, for each position i, the sum of code[j] * B**j over
j < i, modulo a prime. Two such arrays (two primes) answer whether any two spans
are equal in constant time, after multiplying by the power that brings them to one
position, and the longest common extension of two positions by binary search.

The fingerprint of a text is read off the arrays, once for each length in ``SPANS``: the hashes
of all spans of that length (shorter texts are one span) are brought to position zero and
mixed to 32 bits, and the ``KEEP`` smallest distinct values are written in hexadecimal,
after the number of code points. Equal texts have equal fingerprints. The likeness of
two fingerprints is the share of common spans (Dice) that their smallest values
estimate, of the longest spans of which the shorter text has room for two side by side: so that
half of it, kept, is at least one. It is exact for texts of at most KEEP distinct spans, 1 for equal
fingerprints and 0 for texts without a common span.

Each document is set beside the next one in descending doc_id. Quantiles of
doc_id cut the order into ranges; a range is one stretch of one task, and the
last document of a range gets its neighbour by a copy of the first document of the next
range that has any, so no document crosses more than one border. An id of many rows (or no id) is
cut by the hash of their texts too, into as many ranges as its share asks for. Rows alike in id and text
stay together, and their hashes are made once.

Edges: null is the empty text; null ids come last; repeated ids are ordered by the hash of
the text, then the text, so that the result is defined; a single document is its own next. Texts of
any length are hashed whole, as UTF-32 in one numpy array each. Empty texts are
like one another (1) and unlike all others (0). An empty table gives an empty
result. Columns besides id and text are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import common

PRIMES = (2147483647, 2147483629)
BASES = (1_000_003_919, 1_442_695_041)
#: Code points of a span, the longest first; of the last, every text has room.
SPANS = (24, 4, 1)
KEEP = 64


class Powers:
    """Powers of the bases and of their inverses, grown as texts ask for."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def grow(self, n: int) -> None:
        for tables, bases in ((self.up, BASES), (self.down, [pow(b, -1, p) for b, p in zip(BASES, PRIMES, strict=True)])):
            for k, (p, b) in enumerate(zip(PRIMES, bases, strict=True)):
                while len(tables[k]) < n:  # doubling: the second half is the first times one power
                    t = tables[k]
                    tables[k] = np.concatenate([t, t * np.uint64(pow(b, len(t), p)) % np.uint64(p)])


POWERS = Powers()


class Prefix:
    """Prefix polynomial hashes of one text."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        POWERS.grow(self.n + 1)
        self.sums = []
        for k, p in enumerate(PRIMES):
            # below 2**31 each, so that 2**33 terms fit
            terms = (codes.astype(np.uint64) + np.uint64(1)) * POWERS.up[k][: self.n] % np.uint64(p)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64) % np.uint64(p)]))

    def spans(self, size: int) -> np.ndarray:
        """One number for each span of ``size`` code points, equal for equal spans."""
        out = np.zeros(self.n - size + 1, np.uint64)
        for k, p in enumerate(PRIMES):
            s, p64 = self.sums[k], np.uint64(p)
            at_zero = (s[size:] + p64 - s[: self.n - size + 1]) * POWERS.down[k][: self.n - size + 1] % p64
            out = out * np.uint64(1 << 32) + at_zero
        return out

    def span(self, at: int, size: int) -> tuple[int, ...]:
        """The hashes of one span, brought to position zero."""
        return tuple(
            (int(self.sums[k][at + size]) - int(self.sums[k][at])) * int(POWERS.down[k][at]) % p for k, p in enumerate(PRIMES)
        )

    def equal(self, at: int, other: Prefix, there: int, size: int) -> bool:
        """Whether two spans are equal."""
        return self.span(at, size) == other.span(there, size)

    def extension(self, at: int, other: Prefix, there: int) -> int:
        """Longest common extension of two positions, by binary search."""
        low, high = 0, min(self.n - at, other.n - there)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(at, other, there, mid) else (low, mid - 1)
        return low


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def smallest_spans(prefix: Prefix, size: int) -> np.ndarray:
    """The smallest distinct mixed hashes of one length of span, sorted; empty for the empty text."""
    if not prefix.n:
        return np.empty(0, np.uint32)
    x = prefix.spans(min(size, prefix.n))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = ((x ^ (x >> np.uint64(29))) >> np.uint64(32)).astype(np.uint32)
    want = KEEP
    while True:  # repeated spans can fill the smallest places
        if want >= len(x):
            return np.unique(x)[:KEEP]
        low = np.unique(np.partition(x, want)[:want])
        if len(low) >= KEEP:
            return low[:KEEP]
        want *= 4


class Sketch(NamedTuple):
    """What a fingerprint says: the number of code points, and for each length the smallest span hashes."""

    n: int
    levels: tuple[np.ndarray, ...]


def sketch(prefix: Prefix) -> Sketch:
    return Sketch(prefix.n, tuple(smallest_spans(prefix, size) for size in SPANS))


def written(made: Sketch) -> str:
    """The fingerprint as text."""
    return ":".join([f"{made.n:x}", *(level.astype(">u4").tobytes().hex() for level in made.levels)])


def read(fingerprint: str) -> Sketch:
    """What a fingerprint says."""
    n, *levels = fingerprint.split(":")
    return Sketch(int(n, 16), tuple(np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32) for x in levels))


def level_of(n: int) -> int:
    """The longest span of which n code points hold two side by side."""
    return next((k for k, size in enumerate(SPANS) if n >= 2 * size), len(SPANS) - 1)


def likeness(one: Sketch, other: Sketch) -> float:
    """Share of common spans, estimated from the smallest hashes of both."""
    level = level_of(min(one.n, other.n))
    a, b = one.levels[level], other.levels[level]
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)
    if len(a) >= KEEP or len(b) >= KEEP:
        union = union[:KEEP]
    common_part = np.intersect1d(np.intersect1d(union, a, assume_unique=True), b, assume_unique=True)
    jaccard = len(common_part) / len(union)
    return 2 * jaccard / (1 + jaccard)


def edit(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following one, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class Seen:
    """A document with its prefix hashes and sketch, which its own row and the row before need."""

    def __init__(self, doc_id: int | None, text: str, stretch: int, guest: bool, before: Seen | None):
        self.doc_id, self.text, self.stretch, self.guest = doc_id, text, stretch, guest
        if before is not None and before.text == text:
            self.prefix, self.sketch, self.edited = before.prefix, before.sketch, before.edited
        else:
            self.prefix = Prefix(codes_of(text))
            self.sketch = sketch(self.prefix)
            self.edited: dict[str, tuple] = {}  # the last edited text's values, by the half that was put in

    def row(self, following: Seen) -> tuple:
        changed = edit(self.text, following.text)
        if changed not in self.edited:
            other = Prefix(codes_of(changed))
            theirs = sketch(other)
            self.edited.clear()
            self.edited[changed] = (
                hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                written(theirs),
                likeness(self.sketch, theirs),
                self.prefix.extension(0, other, 0),
            )
        digest, fingerprint, near, shared = self.edited[changed]
        return (self.doc_id, len(self.text), digest, written(self.sketch), fingerprint, near, likeness(self.sketch, following.sketch), shared)


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_prefix long"
)


def _fingerprint_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, in descending order, a range's guest last; each is held back until the next is seen."""
    held: Seen | None = None
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    for whole in batches:
        for batch in common.slices(whole, "text"):
            out = []
            for values in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "stretch", "guest")), strict=True):
                now = Seen(*values, held)
                if held is not None and held.stretch == now.stretch and not held.guest:
                    out.append(held.row(now))
                held = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


TOP = 2.0**63


def stretches(keys: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Where about n ranges of equal size are cut, from keys (doc_id, h).

    Returns the ids at the cuts, ascending; the number of ranges by hash that each of them has for itself; and that of null.
    """
    found = keys.agg(
        F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("q"), F.count("*").alias("rows"), F.count("doc_id").alias("ids")
    ).first()
    cuts, times = np.unique(np.array(found["q"] or [], np.int64), return_counts=True)
    nulls = math.ceil(n * (found["rows"] - found["ids"]) / max(found["rows"], 1))
    # a cut that comes k times stands for the share of k ranges: its id has k + 1 ranges of its own
    own = np.where(times > 1, times + 1, 1)
    return cuts, own, max(nulls, 1)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness; see the module."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = common.stored(rows.select("doc_id", "h"), "keys")
    n = ranges or max(2, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts, own, nulls = stretches(keys, n)
    # numbers rise as ids fall: each cut opens the ranges of its id, then those of the ids below it down to the next
    opened = np.concatenate([[0], np.cumsum(own[::-1] + 1)])  # ranges before the k-th cut from above
    last = int(opened[-1]) + 1

    @F.pandas_udf("int")
    def place(doc_id: pd.Series, h: pd.Series) -> pd.Series:
        """The number of a row's range."""
        falling = (TOP - 1 - h.to_numpy().astype(np.float64)) / (2 * TOP)  # 0 to 1 as the hash falls
        here = doc_id.notna().to_numpy()
        ids = doc_id.to_numpy()[here].astype(np.int64)
        out = last + np.minimum((falling * nulls).astype(np.int64), nulls - 1)
        above = len(cuts) - np.searchsorted(cuts, ids, "right")  # cuts greater than the id
        is_cut = np.isin(ids, cuts)
        parts = np.append(own[::-1], 1)[above]
        out[here] = opened[above] + np.where(is_cut, np.minimum((falling[here] * parts).astype(np.int64), parts - 1) + 1, 0)
        return pd.Series(out.astype(np.int32))

    stretch = place("doc_id", "h")
    # the first row of each stretch that has any: at most one per cut
    order = F.struct("doc_id", "h")  # a null id is the least
    heads = keys.groupBy(stretch.alias("stretch")).agg(F.max(order).alias("head")).collect()
    heads = sorted(((r["stretch"], r["head"]) for r in heads), key=lambda x: x[0])
    guests = [(*(heads[i + 1][1] if i + 1 < len(heads) else heads[0][1]), s) for i, (s, _) in enumerate(heads)]
    guest_of = spark.createDataFrame(guests, "head long, head_h long, host int")
    own_rows = rows.withColumn("stretch", stretch).withColumn("guest", F.lit(False))
    # rows with the key of a head visit the stretch before; only the first of them is used there
    is_head = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h"))
    visiting = rows.join(F.broadcast(guest_of), is_head).select("doc_id", "text", "h", F.col("host").alias("stretch"), F.lit(True).alias("guest"))
    visiting = visiting.groupBy("doc_id", "h", "stretch", "guest").agg(F.max("text").alias("text")).select("doc_id", "text", "h", "stretch", "guest")
    both = own_rows.unionByName(visiting)
    dealt = both.repartitionByRange(last + nulls, "stretch").sortWithinPartitions(
        "stretch", "guest", F.col("doc_id").desc_nulls_last(), F.col("h").desc(), F.col("text").desc()
    )
    return dealt.select("doc_id", "text", "stretch", "guest").mapInArrow(_fingerprint_ranges, SCHEMA)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_documents(common.table(spark, sf_dir, "documents"))

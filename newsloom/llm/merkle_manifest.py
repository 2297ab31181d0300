"""Merkle manifest of a dataset over an external-memory node store (operator 11).

Every row is a leaf: the SHA-256 of its fields, each ``-`` if null, else its bytes'
number, a colon and its value. The leaves of a group form a binary tree, and the
groups' roots, in the order of their keys, form the tree above.

1. *Leaf runs.* Digests (never texts) are range-sorted by group, id and digest into runs, stored as
   ``level=0``. A run is a partition; running counts of runs turn a row's place in
   its run into its coordinate in the group.
2. *Levels.* A pass reads one stored level in blocks of 2**STRIDE consecutive coordinates and streams out the
   STRIDE levels above it, written as Parquet partitioned by level. So a hundred
   billion leaves take four passes, a block fits in a task's memory, and a group
   that holds most rows is many blocks.
3. *Proofs.* From the top down, a pass merges the path of each block's root with the stored nodes
   below it, sorted by coordinate, and writes the paths of the level at the
   bottom; the last pass gives those of the leaves.

The tree above the groups is built by the same steps, so the number of groups may grow too.

Edges: a null group comes first, a null id first in its group; rows that agree in group and id are
ordered by digest, and those that agree in it too are interchangeable, each with a proof of its own. A lone
leaf is its own root and has the digest of no bytes as proof. Texts are hashed whole by Spark. An
empty table gives an empty result. Columns that are not named are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import common

#: Levels that one pass builds: a block has 2**STRIDE nodes.
STRIDE = 12
#: Bytes of one step of a path: where the sibling stands (L, R, or - if there is none), then its digest in hex.
STEP = 65
NODE = "grp string, n long, idx long, digest binary"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A field as the leaf's hash takes it."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Digest of a row's fields."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def joined(*digests: bytes) -> bytes:
    """Digest of a node: its children's digests as hex text, one after the other."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def height(n: int) -> int:
    """Levels above the leaves of a group of n."""
    return (n - 1).bit_length()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows of one (grp, block), over the borders of batches."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for key, block in groupby(rows, key=lambda r: (r["grp"], r["block"])):
        yield key, list(block)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


RISEN = pa.schema([("grp", pa.string()), ("n", pa.int64()), ("idx", pa.int64()), ("digest", pa.binary()), ("level", pa.int32())])


def _climb(base: int, stride: int):
    """From the nodes of one level, in blocks, the nodes of the levels above."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (grp, block), rows in _blocks(batches):
            n = rows[0]["n"]
            now = [r["digest"] for r in rows]
            for level in range(base + 1, min(base + stride, height(n)) + 1):
                now = [joined(*now[i : i + 2]) for i in range(0, len(now), 2)]
                first = block << (base + stride - level)
                yield from ((grp, n, first + i, d, level) for i, d in enumerate(now))

    return lambda batches: _batches(nodes(batches), RISEN)


PATH = "grp string, block long, path binary, subroot binary, root binary"
SUNK = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())])


def _paths(rows: list[dict], base: int) -> tuple[dict, list[tuple[dict, bytes]]]:
    """Of one block: the row with its root's path, and each node of its lowest level with its own path."""
    above, levels = None, {}
    for r in rows:
        if r["level"] < 0:
            above = r
        else:
            levels.setdefault(r["level"], []).append(r)
    tails = [above["path"]]  # of the nodes of the level above the present one
    for level in sorted(levels, reverse=True):
        digests = [r["digest"].hex().encode() for r in levels[level]]
        steps = []
        for i in range(len(digests)):
            there = i ^ 1
            steps.append(b"-" * STEP if there == len(digests) else (b"L" if there < i else b"R") + digests[there])
        if len(digests) == 1 and level == base and above["lone"]:
            steps = [b""]  # a group of one leaf has no level above it
        tails = [step + tails[i >> 1] for i, step in enumerate(steps)]
    return above, list(zip(levels[base], tails, strict=True))


def _descend(base: int):
    """Paths of the nodes of a level from those of the block roots above; a node of it is a block of the next pass."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (grp, _), block in _blocks(batches):
            above, found = _paths(block, base)
            yield from ((grp, r["idx"], path, above["subroot"], above["root"]) for r, path in found)

    return lambda batches: _batches(rows(batches), SUNK)


def steps(path: bytes) -> list[tuple[str, bytes]]:
    """A path as (side, sibling in hex), from the leaf up; a lone node's side is ``-``."""
    return [(chr(path[i]), path[i + 1 : i + STEP]) for i in range(0, len(path), STEP)]


def proof_digest(path: bytes) -> str:
    """Digest of the siblings on a path, in order."""
    return sha256(b"".join(s for side, s in steps(path) if side != "-")).hexdigest()


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    now = digest.hex().encode()
    for side, sibling in steps(path):
        both = now if side == "-" else sibling + now if side == "L" else now + sibling
        now = sha256(both).hexdigest().encode()
    return bytes.fromhex(now.decode())


@dataclass
class Tree:
    """A stored tree over each group's leaves; see the module."""

    spark: SparkSession
    path: str
    payload: list[str]
    runs: DataFrame
    levels: int
    stride: int

    def leaves(self) -> DataFrame:
        """The leaves with their coordinates: grp, n, idx, digest and the payload."""
        r = self.runs.select(F.col("grp").alias("run_grp"), F.col("part").alias("run_part"), "first", "before", "n")
        found = self._level(0).join(r, F.col("grp").eqNullSafe(F.col("run_grp")) & (F.col("part") == F.col("run_part")))
        return found.select("grp", "n", (F.col("seq") - F.col("first") + F.col("before")).alias("idx"), "digest", *self.payload)

    def _level(self, level: int) -> DataFrame:
        return self.spark.read.schema(NODE if level else self.leaf_schema).parquet(f"{self.path}/level={level}")

    def nodes(self, low: int, high: int) -> DataFrame:
        """The stored nodes of levels low to high - 1 (low above 0), with their level."""
        paths = [f"{self.path}/level={k}" for k in range(low, min(high, self.levels + 1))]
        if not paths:
            return self.spark.createDataFrame([], f"{NODE}, level int")
        return self.spark.read.option("basePath", self.path).schema(f"{NODE}, level int").parquet(*paths)

    def roots(self) -> DataFrame:
        """grp, n and the root's digest of each group."""
        top = self.nodes(1, self.levels + 1).where("idx = 0 and n > shiftleft(1L, level - 1) and n <= shiftleft(1L, level)")
        return self.leaves().where("n = 1").select("grp", "n", "digest").unionByName(top.select("grp", "n", "digest"))

    def merged(self, base: int, above: DataFrame) -> DataFrame:
        """Paths of block roots and the nodes of one stride, dealt by block and sorted by coordinate."""
        top = base + self.stride
        nodes = self.nodes(max(base, 1), top)
        if base == 0:
            nodes = nodes.unionByName(self.leaves().withColumn("level", F.lit(0)), allowMissingColumns=True)
        nodes = nodes.withColumn("block", F.expr(f"shiftright(idx, {top} - level)")).where(F.col("n") > F.expr("shiftleft(1L, level)") if base else F.expr("level = 0 or n > shiftleft(1L, level)"))
        both = nodes.unionByName(above.withColumn("level", F.lit(-1)), allowMissingColumns=True)
        return both.repartition("grp", "block").sortWithinPartitions("grp", "block", "level", "idx")

    def leaf_paths(self, seeds: DataFrame) -> DataFrame:
        """Merged rows of the last pass; seeds: grp, n, path, subroot and root of each group's root."""
        seeds = seeds.withColumn("block", F.lit(0).cast("long")).withColumn("lone", F.col("n") == 1)
        paths = None
        for base in reversed(range(0, max(self.levels, 1), self.stride)):
            here = f"n > shiftleft(1L, {base}) and n <= shiftleft(1L, {base + self.stride})" + (" or n = 1" if base == 0 else "")
            above = seeds.where(here).drop("n")
            if paths is not None:
                above = above.unionByName(paths.withColumn("lone", F.lit(False)))
            merged = self.merged(base, above)
            if base:
                paths = common.stored(merged.mapInArrow(_descend(base), PATH), f"paths_{base}")
        return merged


def build(leaves: DataFrame, order: list[str], payload: list[str], stride: int = STRIDE) -> Tree:
    """Store the leaves (grp, digest and payload) in order, and all levels above."""
    spark = leaves.sparkSession
    path = f"{common.shared_dir(spark).rstrip('/')}/newsloom/{uuid.uuid4().hex}/nodes"
    # rows alike in everything are told apart by their place in the stored table, so that they split too
    leaves = leaves.withColumn("place", F.monotonically_increasing_id())
    order = ["grp", *order, "digest", "place"]
    runs = leaves.repartitionByRange(*order).sortWithinPartitions(*order).drop("place")
    runs = runs.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    with common.settings(spark, common.WRITING):
        runs.write.option("compression", "zstd").parquet(f"{path}/level=0")
    tree = Tree(spark, path, payload, None, 0, stride)
    tree.leaf_schema = runs.schema
    counted = tree._level(0).groupBy("grp", "part").agg(F.count("*").alias("rows"), F.min("seq").alias("first"))
    up_to = Window.partitionBy("grp").orderBy("part")
    tree.runs = common.stored(
        counted.select(
            "grp", "part", "first", (F.sum("rows").over(up_to) - F.col("rows")).alias("before"), F.sum("rows").over(Window.partitionBy("grp")).alias("n")
        ),
        "runs",
    )
    tree.levels = height(tree.runs.agg(F.max("n")).first()[0] or 1)
    for base in range(0, tree.levels, stride):
        now = (tree.leaves() if base == 0 else tree._level(base)).select("grp", "n", "idx", "digest").where(F.col("n") > F.lit(1 << base))
        dealt = now.withColumn("block", F.shiftright("idx", stride)).repartition("grp", "block").sortWithinPartitions("grp", "block", "idx")
        risen = dealt.mapInArrow(_climb(base, stride), f"{NODE}, level int")
        with common.settings(spark, common.WRITING):
            risen.write.option("compression", "zstd").partitionBy("level").mode("append").parquet(path)
    return tree


@dataclass
class Manifest:
    """The trees of the groups, the tree of their roots, and the digest of the whole."""

    groups: Tree
    top: Tree
    root: bytes | None

    def merged(self) -> DataFrame:
        """What the last proof pass reads: leaves, nodes and block roots' paths by coordinate."""
        root = F.lit(self.root)
        whole = self.top.roots().select("grp", "n", F.lit(b"").alias("path"), F.col("digest").alias("subroot"), root.alias("root"))
        seeds = self.top.leaf_paths(whole).mapInArrow(_seeds, "grp string, n long, path binary, subroot binary")
        return self.groups.leaf_paths(common.stored(seeds, "seeds").withColumn("root", root))

    def proofs(self) -> DataFrame:
        """doc_id, leaf, subroot, root (hex) and the path of each leaf."""
        return self.merged().mapInArrow(_proofs, "doc_id long, leaf string, subroot string, root string, path binary")


SEEDS = pa.schema([("grp", pa.string()), ("n", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary())])


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A leaf of the top tree is the root of a group."""
    found = ((r["key"], r["size"], path, r["digest"]) for _, block in _blocks(batches) for r, path in _paths(block, 0)[1])
    return _batches(found, SEEDS)


PROOFS = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("path", pa.binary())])


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for _, block in _blocks(batches):
            above, found = _paths(block, 0)
            yield from ((r["doc_id"], r["digest"].hex(), above["subroot"].hex(), above["root"].hex(), path) for r, path in found)

    return _batches(rows(), PROOFS)


CHECKED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for _, block in _blocks(batches):
            above, found = _paths(block, 0)
            subroot, root = above["subroot"].hex(), above["root"].hex()
            for r, path in found:
                end = folded(r["altered"] or r["digest"], path).hex()
                yield r["doc_id"], r["digest"].hex(), subroot, root, proof_digest(path), end, end == root

    kinds = [("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())]
    return _batches(rows(), pa.schema(kinds))


def build_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, altered: Column | None = None, stride: int = STRIDE) -> Manifest:
    """Store the trees of docs. ``altered``: the leaf of a row as it is found later, null where it is unchanged."""
    own = docs.select(
        F.col(group_col).cast("string").alias("grp"),
        F.col(id_col).cast("long").alias("doc_id"),
        leaf(*(F.col(c) for c in fields)).alias("digest"),
        (F.lit(None) if altered is None else altered).cast("binary").alias("altered"),
    )
    groups = build(common.stored(own, "leaves"), ["doc_id"], ["doc_id", "altered"], stride)
    subroots = groups.roots().select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("key"), F.col("n").alias("size"), "digest")
    top = build(common.stored(subroots, "subroots"), ["key"], ["key", "size"], stride)
    root = top.roots().first()
    return Manifest(groups, top, bytes(root["digest"]) if root else None)


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row after one is added to n_chars, where 7 divides its id's checksum; else null."""
    changed = leaf(*(F.col(c) if c != "n_chars" else F.col(c).cast("decimal(20,0)") + 1 for c in FIELDS))
    return F.when(F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0), changed)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, and whether they still hold after some were changed."""
    docs = common.table(spark, sf_dir, "documents")
    return build_manifest(docs, altered=tampered(docs)).merged().mapInArrow(_checked, CHECKED)


OP11_SQL = r"""
with recursive
bits(b, k, c) as (
  select b, 0, cast(b as ubigint) from range(256) t(b)
  union all
  select b, k + 1, case when c & 1 = 1 then xor(c >> 1, cast(3988292384 as ubigint)) else c >> 1 end from bits where k < 8),
ids as (select distinct doc_id, cast(doc_id as varchar) s from documents where doc_id is not null),
sums(doc_id, s, k, c) as (
  select doc_id, s, 0, cast(4294967295 as ubigint) from ids
  union all
  select sums.doc_id, s, sums.k + 1, xor(bits.c, sums.c >> 8)
  from sums join bits on bits.k = 8 and bits.b = xor(sums.c, cast(ord(s[sums.k + 1]) as ubigint)) & 255 where sums.k < length(s)),
changed as (select doc_id from sums where k = length(s) and xor(c, cast(4294967295 as ubigint)) % 7 = 0),
fields as (
  select doc_id, lang, n_chars is not null and doc_id in (select doc_id from changed) altered,
         coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') head,
         coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') chars,
         coalesce(strlen(cast(n_chars + 1 as varchar)) || ':' || (n_chars + 1), '-') more,
         coalesce(strlen(text) || ':' || text, '-') tail
  from documents),
leaves as (
  select doc_id, lang, leaf, case when altered then sha256(head || more || tail) else leaf end found,
         row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 i, count(*) over (partition by lang) n
  from (select *, sha256(head || chars || tail) leaf from fields)),
up(lang, n, lvl, i, d) as (
  select lang, n, 0, i, leaf from leaves
  union all
  select lang, n, lvl + 1, i // 2, sha256(string_agg(d, '' order by i)) from up where n > (1 << lvl) group by lang, n, lvl, i // 2),
subroots as (select lang, d, row_number() over (order by lang nulls first) - 1 i, count(*) over () n from up where n <= (1 << lvl)),
top(n, lvl, i, d) as (
  select n, 0, i, d from subroots
  union all
  select n, lvl + 1, i // 2, sha256(string_agg(d, '' order by i)) from top where n > (1 << lvl) group by n, lvl, i // 2),
root as (select d from top where n <= (1 << lvl)),
paths as (
  select l.doc_id, l.leaf, l.found, l.lang, l.i, 0 part, u.lvl, case when s.d is null then '-' when l.i >> u.lvl & 1 = 1 then 'L' || s.d else 'R' || s.d end step
  from leaves l join up u on u.lang is not distinct from l.lang and u.i = l.i >> u.lvl and l.n > (1 << u.lvl)
  left join up s on s.lang is not distinct from l.lang and s.lvl = u.lvl and s.i = xor(u.i, 1)
  union all
  select l.doc_id, l.leaf, l.found, l.lang, l.i, 1, u.lvl, case when s.d is null then '-' when r.i >> u.lvl & 1 = 1 then 'L' || s.d else 'R' || s.d end
  from leaves l join subroots r on r.lang is not distinct from l.lang join top u on u.i = r.i >> u.lvl and r.n > (1 << u.lvl)
  left join top s on s.lvl = u.lvl and s.i = xor(u.i, 1)),
gathered as (
  select l.doc_id, l.leaf, l.lang, l.found, coalesce(list(p.step order by p.part, p.lvl) filter (where p.step is not null), []) steps
  from leaves l left join paths p on p.lang is not distinct from l.lang and p.i = l.i group by l.doc_id, l.leaf, l.lang, l.found, l.i)
select g.doc_id, g.leaf, r.d subroot, root.d root,
       sha256(array_to_string(list_transform(list_filter(steps, lambda s: s <> '-'), lambda s: s[2:]), '')) proof_sha256,
       list_reduce(list_prepend(found, steps), lambda a, s: case s[1] when 'L' then sha256(s[2:] || a) when 'R' then sha256(a || s[2:]) else sha256(a) end) folded_root,
       folded_root = root.d verified
from gathered g join subroots r on r.lang is not distinct from g.lang cross join root
"""

"""Exact deduplication over an extendible-hash index on shared files (operator 7, native).

The text of a row is normalised by deleting ASCII white space; rows whose
normalised texts are the same bytes form a group.

1. *Keys.* Each row's hash key, code points and id are written to the shared folder.
2. *Directory.* Keys, not rows, are counted per hash prefix, and the directory doubles
   while a bucket holds more keys than its capacity: splitting a bucket looks at one
   more bit of the hash. The driver holds 2**DRIVER_DEPTH prefixes at most; a prefix that
   is still overfull gets further bits by its own count, which is checked until every
   bucket fits (or its keys have no bits left). So buckets keep to their capacity at any size.
3. *Routing.* Each text is sent once, to the owner of its key: a range of buckets in key order, which the
   directory cuts so that owners have about equal numbers of keys. Keys of more than 1 / HOT of all rows (fewer than
   HOT) are folded in each task first, so a group that holds a third of all rows leaves a task as one row.
4. *Owners.* In the owner's task, with no further exchange, texts of one key form a
   chain, told apart by their bytes; every entry keeps its survivor and size. The owners
   write the index to the shared folder, sorted by bucket and key; its files are key ranges.
5. *Probing.* Every row looks up its bucket and key. Where the chain has one text, that is
   the row's: the index was built of these rows. Where it has more, the row walks
   it with its own text, comparing bytes. Keys of large groups are joined by a broadcast
   of at most HOT such entries and their rows need no shuffle.

Behaviour at the edges: a null text counts as empty, and all empty or
white-space texts form one group. A null doc_id is a row like any other and
never wins against an id; repeated rows all count, and one representative row
is kept per group: of rows that agree in code points and doc_id too, all are
marked kept, since nothing tells them apart. Columns of the caller beyond
doc_id and text are ignored; an empty table gives an empty result. Ids are integers.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import common

MAX_ID = 2**63 - 1
#: More than any two ids are apart, so that code points decide first.
ID_SPAN = 2 * 10**19
#: Leading bits of which the driver holds the directory.
DRIVER_DEPTH = 12
#: Groups with more than 1 / HOT of all rows are joined by broadcast.
HOT = 1000


def normalised(text: str | Column) -> Column:
    """The text without ASCII white space; null gives the empty text."""
    out = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for space in common.ASCII_SPACE:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str, key_bits: int) -> DataFrame:
    """doc_id, n_cp, h (the leading ``key_bits`` of the text's hash) and body of each row."""
    h = F.xxhash64("body") if key_bits == 64 else F.shiftleft(F.shiftright(F.xxhash64("body"), 64 - key_bits), 64 - key_bits)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_cp"),
        normalised(text_col).alias("body"),
    ).select("doc_id", "n_cp", h.alias("h"), "body")


def grow_directory(counts: dict[int, int], capacity: int, max_depth: int) -> list[tuple[int, int, int]]:
    """Split overfull buckets by directory doubling.

    ``counts`` gives the keys per prefix of ``max_depth`` leading bits. Returns
    (local depth, bucket prefix, keys) in key order; the prefixes partition
    the key space. A bucket deeper than max_depth is not split here.
    """
    work, done = [(0, 0)], []
    while work:
        depth, prefix = work.pop()
        shift = max_depth - depth
        n = sum(counts.get(k, 0) for k in range(prefix << shift, (prefix + 1) << shift))
        if n > capacity and depth < max_depth:
            work += [(depth + 1, prefix * 2 + 1), (depth + 1, prefix * 2)]
        else:
            done.append((depth, prefix, n))
    return sorted(done, key=lambda x: x[1] << (max_depth - x[0]))


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("h", 64 - bits).alias("prefix")


def _bucket(depth: Column) -> Column:
    """The leading ``depth`` bits of h, marked with a bit before them so that depths differ."""
    bits = F.when(depth < 64, F.expr("shiftrightunsigned(h, 64 - depth)")).otherwise(F.col("h"))
    return F.when(depth == 0, F.lit(1)).when(depth < 63, bits + F.expr("shiftleft(1L, depth)")).otherwise(bits).cast("long")


def directory(keys: DataFrame, capacity: int, driver_depth: int = DRIVER_DEPTH) -> DataFrame:
    """prefix -> depth for all 2**driver_depth prefixes: how many bits of a key name its bucket.

    ``keys`` (h) is a stored table of distinct keys.
    """
    spark = keys.sparkSession
    counts = {r["prefix"]: r["n"] for r in keys.groupBy(_prefix(driver_depth)).agg(F.count("*").alias("n")).collect()}
    depths = {}
    for depth, prefix, n in grow_directory(counts, capacity, driver_depth):
        span = 1 << (driver_depth - depth)
        # overfull at the driver's depth: as many more bits as even halves would take
        more = max(0, (-(-n // capacity) - 1).bit_length()) if depth == driver_depth else 0
        depths |= dict.fromkeys(range(prefix * span, (prefix + 1) * span), depth + more)
    while True:
        table = spark.createDataFrame(sorted(depths.items()), "prefix long, depth int")
        if max(depths.values()) <= driver_depth:
            return table
        routed = keys.withColumn("prefix", _prefix(driver_depth)).join(F.broadcast(table), "prefix").where(F.col("depth").between(driver_depth + 1, 63))
        sizes = routed.groupBy("prefix", _bucket(F.col("depth")).alias("bucket")).agg(F.count("*").alias("n"))
        full = [r["prefix"] for r in sizes.where(F.col("n") > capacity).select("prefix").distinct().collect()]  # prefixes of the driver's depth
        if not full:
            return table
        depths |= {p: depths[p] + 1 for p in full}


def routed(keyed: DataFrame, table: DataFrame, driver_depth: int = DRIVER_DEPTH) -> DataFrame:
    """keyed rows with the bucket of their key and its owner; the table has 2**driver_depth rows."""
    rows = keyed.withColumn("prefix", _prefix(driver_depth)).join(F.broadcast(table), "prefix")
    return rows.withColumn("bucket", _bucket(F.col("depth"))).drop("prefix", "depth")


def with_owners(table: DataFrame, keys: DataFrame, owners: int, driver_depth: int = DRIVER_DEPTH) -> DataFrame:
    """The directory with the owner of each prefix: key ranges of about equal numbers of keys, cut between prefixes."""
    counts = {r["prefix"]: r["n"] for r in keys.groupBy(_prefix(driver_depth)).agg(F.count("*").alias("n")).collect()}  # 2**driver_depth rows at most
    share = max(sum(counts.values()) / owners, 1e-9)
    rows, before = [], 0
    for prefix, depth in sorted((r["prefix"], r["depth"]) for r in table.collect()):
        n = counts.get(prefix, 0)
        rows.append((prefix, depth, min(owners - 1, int((before + n / 2) / share))))
        before += n
    return table.sparkSession.createDataFrame(rows, "prefix long, depth int, owner int")


def _folded(texts: DataFrame) -> DataFrame:
    """One row for each text of a key: its survivor's rank, and the number of its rows. Bytes are compared."""
    return texts.groupBy("owner", "bucket", "h", "body").agg(F.max("rank").alias("rank"), F.count("*").alias("group_size"))


def _chains(folded: DataFrame) -> DataFrame:
    """The chain of each key, in the order of digests; a text is kept in it only where it has to be told from another."""
    span, top = F.lit(Decimal(ID_SPAN)), F.lit(Decimal(MAX_ID))
    left = F.col("rank") % span
    entry = F.struct(
        F.sha2("body", 256).alias("digest"),
        ((F.col("rank") - left) / span).cast("long").alias("best"),
        F.when(left > 0, top - left + 1).cast("long").alias("keep_id"),
        "group_size",
        "body",
    )
    bare = F.transform("chain", lambda e: e.withField("body", F.lit(None).cast("string")))
    chains = folded.select("owner", "bucket", "h", entry.alias("entry")).groupBy("owner", "bucket", "h").agg(F.array_sort(F.collect_list("entry")).alias("chain"))
    return chains.select("owner", "bucket", "h", F.when(F.size("chain") > 1, F.col("chain")).otherwise(bare).alias("chain"))


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 50_000, driver_depth: int = DRIVER_DEPTH, key_bits: int = 64
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, index, directory); index and directory are stored.

    rows: doc_id, n_cp, h, bucket of each row. index: a row per key with bucket, h and its chain of
    (digest, best: most code points, keep_id: smallest id among those, group_size, body: only in chains of several).
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col, key_bits)
    plain = common.stored(keyed.drop("body"), "rows")
    counted = common.stored(plain.groupBy("h").agg(F.count("*").alias("n")), "keys")
    keys = counted.select("h")
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = common.stored(with_owners(directory(keys, capacity, driver_depth), keys, owners, driver_depth), "directory")
    # One number orders rows by code points, then smallest id; a null id comes last.
    span, top = F.lit(Decimal(ID_SPAN)), F.lit(Decimal(MAX_ID))
    rank = F.col("n_cp").cast("decimal(12,0)") * span + F.coalesce(top - F.col("doc_id") + 1, F.lit(Decimal(0)))
    texts = routed(keyed, table, driver_depth).select("owner", "bucket", "h", "body", rank.cast("decimal(38,0)").alias("rank"))
    n = plain.count()
    hot = F.broadcast(counted.where(F.col("n") * HOT > n).select("h"))  # fewer than HOT keys
    # the one exchange of texts is by owner; both foldings keep to it
    cold = _chains(_folded(texts.join(hot, "h", "left_anti").repartitionById(owners, "owner")))
    large = _chains(_folded(texts.join(hot, "h", "left_semi")))
    index = cold.unionByName(large).sortWithinPartitions("bucket", "h").drop("owner")
    return routed(plain, table, driver_depth).drop("owner"), common.stored(index, "index"), table


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 50_000, driver_depth: int = DRIVER_DEPTH, key_bits: int = 64
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, index, table = build_index(docs, id_col, text_col, capacity, driver_depth, key_bits)
    single = index.where("size(chain) = 1").select("bucket", "h", F.get("chain", F.lit(0)).dropFields("body").alias("entry"))
    n = rows.agg(F.count("*")).first()[0]
    # fewer than HOT entries
    hot = common.stored(single.where(F.col("entry.group_size") * HOT > n).select(F.col("h").alias("hot_h"), F.col("entry").alias("hot")), "hot")
    # rows of hot keys probe here; a number of their own in place of the key keeps them apart in the join
    known = rows.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(hot), F.col("h") == F.col("hot_h"), "left")
    cold = F.col("hot").isNull()
    known = known.select("doc_id", "n_cp", "hot", F.when(cold, F.col("bucket")).otherwise(0).alias("bucket"), F.when(cold, F.col("h")).otherwise(F.col("row")).alias("h"))
    probed = known.join(single, ["bucket", "h"], "left").select("doc_id", "n_cp", F.coalesce("hot", "entry").alias("entry")).where("entry is not null")
    chained = index.where("size(chain) > 1")
    if not chained.isEmpty():
        texts = routed(_keyed(docs, id_col, text_col, key_bits), table, driver_depth).drop("owner")
        walked = texts.join(chained, ["bucket", "h"]).select("doc_id", "n_cp", F.get(F.filter("chain", lambda e: e["body"] == F.col("body")), F.lit(0)).dropFields("body").alias("entry"))
        probed = probed.unionByName(walked)
    return probed.select(
        "doc_id",
        "entry.keep_id",
        "entry.group_size",
        ((F.col("n_cp") == F.col("entry.best")) & F.col("doc_id").eqNullSafe(F.col("entry.keep_id"))).alias("kept"),
        F.col("entry.digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 50_000) -> DataFrame:
    """The rows of docs that stay, with their columns; of rows alike in id and text, one.

    A row is looked up by its own id, hash and length among the entries that
    stay, so that the copies of a large group spread over all tasks; its digest decides.
    """
    _, index, _ = build_index(docs, id_col, text_col, capacity)
    stays = index.select("h", F.explode("chain").alias("e")).select(
        F.xxhash64("e.keep_id", F.col("e.keep_id").isNull(), "h", "e.best").alias("__key"), F.col("e.digest").alias("__stays"), F.col("e.best").alias("__best")
    )
    body = normalised(text_col)
    length = F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    keyed = docs.withColumns(
        {"__digest": F.sha2(body, 256), "__n": length, "__key": F.xxhash64(id_col, F.col(id_col).isNull(), F.xxhash64(body), length)}
    )
    found = keyed.join(stays, "__key").where("__digest = __stays and __n = __best")
    return found.dropDuplicates(["__key", "__digest"]).select(*[docs[c] for c in docs.columns])


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents."""
    return exact_dedup(common.table(spark, sf_dir, "documents"))


OP7_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) n_cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') body
  from documents),
g as (
  select body, count(*) group_size, first(doc_id order by n_cp desc, doc_id nulls last) keep_id from d group by body)
select d.doc_id, g.keep_id, cast(g.group_size as bigint) group_size,
       d.doc_id is not distinct from g.keep_id as kept, sha256(d.body) text_sha256
from d join g using (body)
"""

"""Mixing sources to target weights by Pareto order sampling (operator 6).

Targets: sources share a budget of words by weight. No target may exceed
``max_repeats`` times its source's size; what that cuts off is shared again
among the rest by weight until no target is above its limit.

Copies: inside a source a document is expected to be used e = min(c * weight,
max_repeats) times, with the c that fills the target: where documents of great weight are at
their limit, the others share the rest. The weight is a column, or goes by
the number of words (``by_words``), so that longer documents are preferred. A document gets floor(e) certain
whole copies, and one more with inclusion probability p = e - floor(e), which differs between
documents. The extra copies of a source are a fixed-size sample in Pareto order: documents
are ranked by Q = (u / (1 - u)) / (p / (1 - p)), the odds of a uniform number
by the odds of inclusion, and the smallest are taken until the words that the
certain copies leave open are used up. The document at the border is taken if
that brings the source nearer to its target. u comes from a keyed hash of the
id and the text, so that reruns and retries agree.

Scale: no source is ever sorted as a whole. Ranks are counted in 4096 bins of
Q / (1 + Q) per source, and again in 4096 bins inside the bin where the words
run out; only documents of that one fine bin are ordered. Shuffles before
that carry one row per task, source and bin. Sources are numbered by range, so that a
table with a source per host is no single task's affair. Weights are rounded to
eighths of a power of two inside 2**-16 and 2**16, so that c takes at most 257 rows per source.

Edges: a null text has size 0 and takes 0 words. A null source is a source of
its own and comes last. Documents without words neither use nor change a
target. Rows that repeat id and text share one rank, so that their source is
filled to the border row by row in any order of equals; which of them is taken
does not alter the result. A weight that is null or not positive gives no copies. An empty table gives an empty result. Columns
besides id, text, source and weight are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import common

BINS = 4096
#: Weight of documents with at least so many words; powers of two, which rounding leaves alone.
BY_WORDS = ((0, 1.0), (50, 2.0), (500, 4.0))


def word_count(text: str) -> Column:
    """Words of a text: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long")


def numbered(sizes: DataFrame) -> DataFrame:
    """sizes with the place of each source in code point order, null last: ranges are sorted apart and their offsets added."""
    order = F.col("source").asc_nulls_last()
    spot = F.monotonically_increasing_id()  # the partition above 33 bits, the row in it below
    dealt = common.stored(sizes.repartitionByRange(order).sortWithinPartitions(order).withColumn("spot", spot), "ordered")
    part = F.shiftright("spot", 33)
    counts = sorted((r["part"], r["n"]) for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row a partition
    offsets, before = [], 0
    for k, n in counts:
        offsets.append((k, before))
        before += n
    table = sizes.sparkSession.createDataFrame(offsets, "part long, before long")
    place = F.col("before") + F.col("spot").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(table), part == F.col("part")).withColumn("place", place).drop("spot", "part", "before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeats: float = 2.0) -> DataFrame:
    """source, source_size, target from (source, source_size): weights repeat in code point order, null last.

    Each round deals the open budget over the sources that are not yet at their
    limit; a round that fixes none is the last. There are at most as many rounds
    as sources, in practice a few, and each moves one row to the driver.
    """
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    now = common.stored(
        numbered(sizes).select("source", "source_size", pick.alias("weight"), (F.col("source_size") * max_repeats).alias("limit")), "sources"
    )
    budget = now.agg(F.sum("source_size")).first()[0] or 0
    budget = budget * share
    level, fixed = 0.0, -1
    while True:
        # level: words per unit of weight; a source is at its limit if its part exceeds that
        full = F.col("weight") * level > F.col("limit")
        row = now.agg(
            F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("limit"))).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("open")
        ).first()
        if row["n"] == fixed or not row["open"]:
            break
        fixed = row["n"]
        level = (budget - (row["used"] or 0.0)) / row["open"]
    return now.select("source", "source_size", F.least(F.col("weight") * level, F.col("limit")).alias("target"))


def _uniform(seed: int) -> Column:
    """A number inside (0, 1) from 52 bits of a digest of seed, id and text."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _own(weight_col: str | None, by_words: tuple[tuple[int, float], ...]) -> Column:
    """A document's weight, rounded to eighths of a power of two; 0 if it has none."""
    if weight_col is None:
        weight = F.lit(float(by_words[0][1]))
        for words, w in by_words[1:]:
            weight = F.when(F.col("size") >= words, F.lit(float(w))).otherwise(weight)
    else:
        weight = F.col("own")
    eighths = F.round(F.log2(F.greatest(F.lit(2.0**-16), F.least(weight, F.lit(2.0**16)))) * 8)
    return F.when(weight > 0, F.pow(F.lit(2.0), eighths / 8)).otherwise(0.0)


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_repeats: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    by_words: tuple[tuple[int, float], ...] = BY_WORDS,
    with_hash: bool = False,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source.

    ``weight_col`` takes the place of ``by_words``: (words at least, weight), from 0 upwards.
    """
    raw = F.col(weight_col).cast("double") if weight_col else F.lit(None).cast("double")
    sized = common.stored(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), raw.alias("own")).select(
            "doc_id", "source", word_count("text").alias("size"), _uniform(seed).alias("u"), "own", F.xxhash64("text").alias("text_h")
        ),
        "sized",
    )
    source_key = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())
    per = common.stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    # the key of a source is its place in a small table: joins on it need no text and no null
    goal = common.stored(targets(per, weights, share, max_repeats).select(source_key.alias("key"), "source_size", "target"), "targets")
    keyed = sized.withColumn("key", source_key).withColumn("own", _own(weight_col, by_words))
    # c: the target less what full weights take, over the mass of the others
    levels = keyed.where("size > 0 and own > 0").groupBy("key", "own").agg(F.sum("size").alias("words")).join(goal, "key")
    above = Window.partitionBy("key").orderBy(F.col("own").desc()).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("key").orderBy(F.col("own").desc()).rowsBetween(0, Window.unboundedFollowing)
    free = F.col("target") - max_repeats * F.coalesce(F.sum("words").over(above), F.lit(0))
    level = (free / F.sum(F.col("own") * F.col("words")).over(below)).alias("c")
    levels = levels.select("key", "own", level)
    fits = F.when(F.col("own") * F.col("c") <= max_repeats, F.struct(-F.col("own"), "c"))
    scale = common.stored(levels.groupBy("key").agg(F.coalesce(F.min(fits)["c"], F.lit(1e300)).alias("c")), "scale")
    goal = common.stored(goal.join(scale, "key", "left"), "goal")
    expected = F.when(F.col("c").isNotNull(), F.least(F.col("c") * F.col("own"), F.lit(float(max_repeats)))).otherwise(0.0)
    ranked = (
        keyed.join(goal, "key")
        .withColumn("e", expected)
        .withColumn("sure", F.floor(F.col("e") + 1e-12))
        .withColumn("p", F.greatest(F.col("e") - F.col("sure"), F.lit(0.0)))
        .withColumn("q", F.try_divide(F.col("u") / (1 - F.col("u")), F.try_divide(F.col("p"), 1 - F.col("p"))))
        .withColumn("v", F.when((F.col("p") > 1e-12) & (F.col("size") > 0), F.coalesce(F.col("q") / (1 + F.col("q")), F.lit(1.0))))
        .withColumn("bin", F.least(F.floor(F.col("v") * BINS), F.lit(BINS - 1)).cast("int"))
        .withColumn("fine", F.least(F.floor((F.col("v") * BINS - F.col("bin")) * BINS), F.lit(BINS - 1)).cast("int"))
        .select("key", "doc_id", "text_h", "source", "size", "source_size", "target", "sure", "v", "bin", "fine")
    )
    need = common.stored(
        ranked.groupBy("key").agg(F.max("target").alias("target"), F.sum(F.col("sure") * F.col("size")).alias("certain")).select(
            "key", F.greatest(F.col("target") - F.col("certain"), F.lit(0.0)).alias("need")
        ),
        "need",
    )
    coarse = _border(ranked.where("v is not null").groupBy("key", "bin").agg(F.sum("size").alias("words")), need, "bin", "coarse")
    in_bin = ranked.where("v is not null").join(coarse.withColumnRenamed("bin", "at"), "key").where("bin = at")
    fine = _border(
        in_bin.groupBy("key", "fine").agg(F.sum("size").alias("words")), coarse.select("key", F.col("left").alias("need")), "fine", "fine"
    )
    cut = common.stored(
        goal.select("key")
        .join(coarse.select("key", F.col("bin").alias("cut")), "key", "left")
        .join(fine.select("key", F.col("fine").alias("fine_cut"), F.col("left").alias("open")), "key", "left"),
        "cut",
    )
    placed = ranked.join(cut, "key").withColumn(
        "border", F.coalesce((F.col("bin") == F.col("cut")) & (F.col("fine") == F.col("fine_cut")), F.lit(False))
    )
    fits = (
        F.col("cut").isNull()
        | (F.col("bin") < F.col("cut"))
        | ((F.col("bin") == F.col("cut")) & (F.col("fine") < F.coalesce("fine_cut", F.lit(BINS))))
    )
    clear = placed.where("not border").withColumn("extra", (F.col("v").isNotNull() & fits).cast("int"))
    # the few documents of the border bin go one by one while half of the next is still open
    line = Window.partitionBy("key", "bin", "fine").orderBy("v", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("size").over(line)
    at_border = placed.where("border").withColumn(
        "extra", (F.col("open") - (upto - F.col("size")) >= F.col("size") / 2.0).cast("int")
    )
    copies = F.col("sure") + F.col("extra")
    return clear.unionByName(at_border).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (copies * F.col("size")).cast("long").alias("taken"),
        copies.cast("int").alias("copies"),
        "source",
        *(["text_h"] if with_hash else []),
    )


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs as often as the mix takes them; rows alike in id and text get the larger of their counts."""
    counts = (
        mix(docs, id_col=id_col, text_col=text_col, with_hash=True, **options)
        .where("copies > 0")
        .groupBy(F.col("doc_id").alias("__id"), F.col("text_h").alias("__h"))
        .agg(F.max("copies").alias("__copies"))
    )
    counts = common.stored(counts, "copies")
    same = (F.xxhash64(text_col) == F.col("__h")) & F.col(id_col).eqNullSafe(F.col("__id"))
    found = docs.join(counts, same)
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[docs[c] for c in docs.columns])


def _border(counted: DataFrame, need: DataFrame, bin_col: str, name: str) -> DataFrame:
    """Per key the first bin with which the words reach the need, and the need left when it begins.

    Keys whose bins all fit have no row.
    """
    line = Window.partitionBy("key").orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0)
    summed = counted.join(need, "key").withColumn("upto", F.sum("words").over(line))
    return common.stored(
        summed.where("upto > need")
        .groupBy("key")
        .agg(F.min(F.struct(bin_col, (F.col("need") - (F.col("upto") - F.col("words"))).alias("left"))).alias("x"))
        .select("key", f"x.{bin_col}", "x.left"),
        name,
    )


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 3, 1, 2, with 150 % of all words and two copies at most."""
    return mix(common.table(spark, sf_dir, "documents"))


OP6_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size,
    (cast(cast('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '-') || ':' || coalesce(text, '')), 1, 13) as ubigint)
       as double) + 0.5) / 4503599627370496.0 u
  from documents),
s as (
  select source, sum(size)::double s, row_number() over (order by source nulls last) - 1 k from d group by source),
w as (
  select source, s, 2.0 * s lim, case k % 3 when 0 then 3.0 when 1 then 1.0 else 2.0 end::double w,
         sum(s) over () * 1.5 budget from s),
f as (
  select *, row_number() over (order by lim / w, source nulls last) - 1 m,
    (budget - coalesce(sum(lim) over (order by lim / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by lim / w, source nulls last rows between current row and unbounded following) lev
  from w),
l as (select coalesce(arg_min(lev, m) filter (w * lev <= lim), 1e300) lev from f),
t as (select f.source, f.s, least(f.w * l.lev, f.lim) target from f, l),
o as (
  select d.*, t.s, t.target, case when size >= 500 then 4.0 when size >= 50 then 2.0 else 1.0 end::double own
  from d join t on d.source is not distinct from t.source),
lv as (select source, own, sum(size)::double words, any_value(target) target from o where size > 0 group by source, own),
lf as (
  select source, own, (target - 2.0 * coalesce(sum(words) over (partition by source order by own desc rows between unbounded preceding and 1 preceding), 0))
    / sum(own * words) over (partition by source order by own desc rows between current row and unbounded following) c from lv),
lc as (select source, coalesce(arg_max(c, own) filter (own * c <= 2.0), 1e300) c from lf group by source),
e as (
  select o.*, case when lc.c is null then 0.0 else least(lc.c * o.own, 2.0) end e
  from o left join lc on o.source is not distinct from lc.source),
p as (select *, floor(e + 1e-12) sure, greatest(e - floor(e + 1e-12), 0.0) p from e),
q as (
  select *, (u / (1 - u)) / (p / (1 - p)) q, p > 1e-12 and size > 0 draws from p),
v as (select *, case when draws then coalesce(q / (1 + q), 1.0) end v,
        greatest(target - sum(sure * size) over (partition by source), 0.0) need from q),
c as (select *, sum(case when draws then size else 0 end) over (
        partition by source order by v nulls last, doc_id, size rows unbounded preceding) upto from v)
select doc_id, size::bigint size, s::bigint source_size, target,
  ((sure + (draws and need - (upto - size) >= size / 2.0)::int) * size)::bigint taken,
  (sure + (draws and need - (upto - size) >= size / 2.0)::int)::int copies, source
from c
"""

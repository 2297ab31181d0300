"""Cross-source duplicates: an inverted index on pair keys and model phrases, then ordered verdicts.

Articles and candidates are rows (link, source_name, title, ts, ordinal, fp), fp a
fingerprint struct; ordinal is the order in which candidates are scanned. Nothing is
compared that shares neither a pair key nor a model phrase.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import temporal
from newsloom.operators import entities as e
from newsloom.operators.storage import kept


def candidate_set(pending: DataFrame, published: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Recent pending rows, then recent published ones, in one numbered order: branch, time, link."""
    recent = lambda df, branch: df.where(F.col("ts") >= now - F.expr(f"interval {days} days")).withColumn("branch", F.lit(branch))
    both = recent(pending, 0).unionByName(recent(published, 1))
    return both.withColumn("ordinal", F.struct("branch", "ts", "link")).drop("branch")


def years(title: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)))


def conflicting_years(a: Column, b: Column) -> Column:
    """Both titles name years, and none in common."""
    return (F.size(years(a)) > 0) & (F.size(years(b)) > 0) & ~F.arrays_overlap(years(a), years(b))


def mentions(title: Column, model: Column, subject: Column) -> Column:
    """A model phrase stands in a title on its own, or is what the extractor finds there."""
    bounded = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.lower(model), F.lit(r"\E(?![a-z0-9])"))
    return F.coalesce(F.regexp(F.lower(F.coalesce(title, F.lit(""))), bounded), F.lit(False)) | F.array_contains(subject["strict"], F.lower(model))


def with_subjects(rows: DataFrame, lexicon: e.Lexicon = e.Lexicon()) -> DataFrame:
    """Adds subject: the fingerprint of the title alone."""
    return rows.withColumn("subject", e.fingerprint(lexicon)(F.coalesce("title", F.lit(""))))


#: Rows of one key that meet in one task, on either side; keys with more are dealt over a grid of tasks.
ROWS_PER_CELL = 4_000
#: Keys cut in this way that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Rejections of an article that are looked at, in candidate order.
RECORDS = 100


def _parts(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """Into how many parts the rows of each key with more than ``size`` are cut; at most one in ``size`` rows has such a key."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > size).select(key, F.ceil(F.col("n") / size).cast("int").alias(name))


def meeting(articles: DataFrame, candidates: DataFrame, key: str, apart: Column, size: int = ROWS_PER_CELL) -> DataFrame:
    """Rows of both index tables that share a key and satisfy a condition.

    The tables hold keys and what the rule needs of a row (link and other name the rows), never the articles.
    A key of many rows is cut by the hash of the links on both sides, and each part of one side meets each of the
    other in a task of its own, so no task gets more than ``size`` rows of either side of a key.
    """
    articles, candidates = kept(articles), kept(candidates)  # small, and read for the counts too
    cut_a, cut_c = _parts(articles, key, size, "parts_a"), _parts(candidates, key, size, "parts_c")
    cuts = kept(cut_a.join(cut_c, key, "full"))
    n = cuts.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return articles.join(candidates, key).where(apart)
    cuts = F.broadcast(cuts) if n <= BROADCAST_ROWS else cuts
    some = lambda name: F.coalesce(F.col(name), F.lit(1))
    every = lambda name: F.explode(F.sequence(F.lit(0), some(name) - 1))
    mine = articles.join(cuts, key, "left").withColumn("cell_a", F.pmod(F.xxhash64("link"), some("parts_a")).cast("int")).withColumn("cell_c", every("parts_c"))
    theirs = candidates.join(cuts, key, "left").withColumn("cell_c", F.pmod(F.xxhash64("other"), some("parts_c")).cast("int")).withColumn("cell_a", every("parts_a"))
    cells = [key, "cell_a", "cell_c"]
    return mine.drop("parts_a", "parts_c").join(theirs.drop("parts_a", "parts_c"), cells).where(apart).drop("cell_a", "cell_c")


def _different() -> Column:
    """Of different sources, not the same article, and without conflicting years."""
    clash = (F.size("years") > 0) & (F.size("other_years") > 0) & ~F.arrays_overlap("years", "other_years")
    return (F.col("source") != F.col("other_source")) & (F.col("link") != F.col("other")) & ~clash


def _pair_index(rows: DataFrame, pairs: Column) -> DataFrame:
    """A row per article and well-formed pair key: the key's parts, and whether the title names its series and model."""
    part = e.parsed_pair(F.col("pair"))
    df = rows.withColumn("keys", pairs).select("link", "source_name", "title", "subject", "ordinal", F.size("keys").alias("n"), F.explode("keys").alias("pair"))
    return df.select(
        "link",
        F.col("source_name").alias("source"),
        years(F.col("title")).alias("years"),
        "ordinal",
        "n",
        "pair",
        F.array_contains("subject.series", part["series"]).alias("titled"),
        ((part["model"] != "*") & mentions(F.col("title"), part["model"], F.col("subject"))).alias("named"),
    )


def pair_matches(articles: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per article and candidate with a shared pair key: its class and what was shared.

    class: block (a distinctive pair whose model and series both titles name), flag (a
    broad pair with a model whose series both titles name), else null; rejected lists
    the series of shared broad pairs that did not qualify.
    """
    mine = _pair_index(articles, F.filter(F.col("fp.pairs"), lambda p: e.parsed_pair(p).isNotNull())).drop("ordinal")
    theirs = _pair_index(candidates.where(e.safe(F.col("fp"))), e.coherent_pairs(F.col("fp")))
    theirs = theirs.select(F.col("link").alias("other"), *(F.col(c).alias(f"other_{c}") for c in ("source", "years", "n", "titled", "named")), "ordinal", "pair")
    both = meeting(mine, theirs, "pair", _different())
    part = e.parsed_pair(F.col("pair"))
    titled = F.col("titled") & F.col("other_titled") & (part["model"] != "*")
    qualified = (part["tier"] == "B") & titled
    grouped = both.groupBy("link", "other").agg(
        F.first("ordinal").alias("ordinal"),
        F.array_sort(F.collect_set("pair")).alias("shared"),
        F.max((part["tier"] == "D") & titled & F.col("named") & F.col("other_named")).alias("strong"),
        F.array_sort(F.collect_set(F.when(qualified, F.col("pair")))).alias("qualified"),
        F.array_sort(F.collect_set(F.when((part["tier"] == "B") & ~qualified, part["series"]))).alias("rejected"),
        (F.first("n") + F.first("other_n")).alias("n_both"),
    )
    kind = F.when(F.col("strong"), F.lit("block")).when(F.size("qualified") > 0, F.lit("flag"))
    return grouped.select("link", "other", "ordinal", kind.alias("class"), "shared", "qualified", "rejected", (F.col("n_both") - F.size("shared")).alias("n_total"))


def pair_verdicts(matches: DataFrame, max_records: int = RECORDS, max_series: int = 16) -> DataFrame:
    """Per article: the first block in candidate order, else the first flag; and what was rejected before a block."""
    first = lambda kind: F.min(F.when(F.col("class") == kind, F.struct("ordinal", "other", "shared", "qualified", "n_total")))
    # only the first rejections of an article are gathered, whatever their number
    in_order = Window.partitionBy("link").orderBy("ordinal", "other")
    few = matches.where(F.size("rejected") > 0).select("link", "ordinal", "other", F.slice("rejected", 1, max_series).alias("series"))
    few = few.withColumn("k", F.row_number().over(in_order)).where(F.col("k") <= max_records)
    few = few.groupBy("link").agg(F.array_sort(F.collect_list(F.struct("ordinal", "other", "series"))).alias("r"))
    out = matches.groupBy("link").agg(first("block").alias("b"), first("flag").alias("f")).join(few, "link", "left")
    # rejections are collected while the scan runs, that is up to the first block
    none = F.array().cast(few.schema["r"].dataType)
    seen = F.filter(F.coalesce("r", none), lambda s: F.col("b").isNull() | (s["ordinal"] < F.col("b.ordinal")))
    return out.select(
        "link",
        F.when(F.col("b").isNotNull(), F.lit("block")).when(F.col("f").isNotNull(), F.lit("flag")).otherwise(F.lit("pass")).alias("decision"),
        F.coalesce("b.other", "f.other").alias("match"),
        F.when(F.col("b").isNotNull(), F.col("b.shared")).otherwise(F.col("f.qualified")).alias("pairs"),
        F.coalesce("b.n_total", "f.n_total").alias("n_total"),
        seen.alias("suppressed"),
    )


def overlap_matches(articles: DataFrame, candidates: DataFrame, now: Column, days: int = 7, flag: float = 0.30) -> DataFrame:
    """Pairs whose model phrases have a Jaccard of at least ``flag``, with the candidates of the last days: link, other, ordinal, sim.

    Phrases are ordered from rare to common. Two sets can only be alike if one of the first phrases of either (all but as
    many as the smaller overlap allows to miss) is among the first of the other, and if their sizes are: so only
    those are indexed, and the common phrases of larger sets join nothing. The phrases themselves come back for pairs that meet.
    """
    own = candidates.where(e.safe(F.col("fp")) & (F.col("ts") >= now - F.expr(f"interval {days} days")))
    some = F.size("fp.strict") > 0
    phrases = lambda df: df.where(some).select("link", F.explode("fp.strict").alias("model"))
    counted = phrases(articles).unionByName(phrases(own)).groupBy("model").agg(F.count("*").alias("rows"))

    def index(df: DataFrame) -> DataFrame:
        sets = phrases(df).join(counted, "model").groupBy("link").agg(F.array_sort(F.collect_list(F.struct("rows", "model"))).alias("order"))
        n = F.size("order")
        first = F.slice("order", F.lit(1), n - F.ceil(n * F.lit(flag) - 1e-9).cast("int") + 1)
        sets = sets.select("link", n.alias("n"), F.explode(F.transform(first, lambda x: x["model"])).alias("model"))
        return sets.join(df.select("link", F.col("source_name").alias("source"), years(F.col("title")).alias("years"), "ordinal"), "link")

    mine = index(articles).drop("ordinal")
    theirs = index(own).select(F.col("link").alias("other"), *(F.col(c).alias(f"other_{c}") for c in ("source", "years", "n")), "ordinal", "model")
    sizes = (F.col("other_n") >= F.col("n") * flag - 1e-9) & (F.col("n") >= F.col("other_n") * flag - 1e-9)
    met = meeting(mine, theirs, "model", _different() & sizes).groupBy("link", "other").agg(F.first("ordinal").alias("ordinal"))
    sets = met.join(articles.select("link", F.col("fp.strict").alias("mine")), "link").join(own.select(F.col("link").alias("other"), F.col("fp.strict").alias("theirs")), "other")
    return sets.select("link", "other", "ordinal", e.jaccard(F.col("mine"), F.col("theirs")).alias("sim")).where(F.col("sim") >= flag)


def overlap_verdicts(matches: DataFrame, articles: DataFrame, candidates: DataFrame, block: float = 0.50) -> DataFrame:
    """Per article the best match of the overlap rule; the earliest wins ties. Only the best one's article is read again."""
    best = matches.groupBy("link").agg(F.min_by(F.struct("other", "sim"), F.struct((-F.col("sim")).alias("s"), F.col("ordinal").alias("o"))).alias("x"))
    best = best.select("link", F.col("x.other").alias("other"), F.col("x.sim").alias("sim"))
    side = lambda df, name, key: df.select(F.col("link").alias(key), F.struct("title", "subject", F.col("fp.strict").alias("strict")).alias(name))
    both = best.join(side(articles, "a", "link"), "link").join(side(candidates, "c", "other"), "other")
    shared = F.array_sort(F.array_intersect("a.strict", "c.strict"))
    named = F.exists(shared, lambda m: mentions(F.col("a.title"), m, F.col("a.subject")) & mentions(F.col("c.title"), m, F.col("c.subject")))
    return both.select(
        "link",
        F.when((F.col("sim") >= block) & named, F.lit("block")).otherwise(F.lit("flag")).alias("decision"),
        F.when((F.col("sim") >= block) & ~named, F.lit("overlap_title_capped")).otherwise(F.lit("overlap")).alias("reason"),
        F.col("other").alias("match"),
        temporal.percent_half_even(F.col("sim")).alias("overlap_pct"),
        shared.alias("models"),
    )


def classed(rows: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Adds k, the same for rows of which both rules say the same: alike in source, years, phrases, keys, what of these the title names, and age.

    Rows without a phrase and a pair key match nothing; their k is null.
    """
    strict, pairs = (F.coalesce(f"fp.{n}", F.array().cast("array<string>")) for n in ("strict", "pairs"))
    part = lambda p: e.parsed_pair(p)
    in_title = lambda p: F.struct(F.array_contains("subject.series", part(p)["series"]), mentions(F.col("title"), part(p)["model"], F.col("subject")))
    said = F.struct(
        "source_name", F.array_sort(years(F.col("title"))).alias("years"), strict.alias("strict"), pairs.alias("pairs"),
        F.transform(pairs, in_title).alias("pairs_named"), F.transform(strict, lambda m: mentions(F.col("title"), m, F.col("subject"))).alias("strict_named"),
        e.coherent_pairs(F.col("fp")).alias("coherent"), e.safe(F.col("fp")).alias("safe"), F.col("ts") >= now - F.expr(f"interval {days} days"),
    )
    return rows.withColumn("k", F.when((F.size(strict) > 0) | (F.size(pairs) > 0), F.sha2(F.to_json(said, {"ignoreNullFields": "false"}), 256)))


def _one_of_each(rows: DataFrame) -> DataFrame:
    """A row per class, under its name: that of the first member, with the least ordinal."""
    of = [c for c in ("source_name", "title", "ts", "fp", "subject") if c in rows.columns]
    out = rows.where("k is not null").groupBy("k").agg(F.min_by(F.struct(*of), "link").alias("x"), F.min("ordinal").alias("ordinal"))
    return out.select(F.col("k").alias("link"), *(F.col(f"x.{c}").alias(c) for c in of), "ordinal")


def verdicts(articles: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
    """Per article: decision, reason, match, pairs, overlap_pct and rejected series, by the pair rule and then the overlap rule.

    Articles and candidates of which the rules say the same are compared once, as classes; an article's matches are the first
    members of the classes that its own meets, so a group of copies costs its classes squared, not its rows.
    Both tables are read several times: keep them stored if their fingerprints are made by Python.
    """
    articles, candidates = kept(classed(articles, now)), kept(classed(candidates, now).where("k is not null"))
    # an article that stands among the candidates under another source must not meet itself there: it is a class of its own
    itself = articles.where("k is not null").select("link", F.col("source_name").alias("s")).join(candidates.select("link", "source_name"), "link")
    itself = itself.where(F.col("s") != F.col("source_name")).select("link", F.col("link").alias("own")).distinct()
    some = articles.where("k is not null").join(itself, "link", "left")
    some = kept(some.withColumn("k", F.concat(F.lit("a"), "k", F.coalesce(F.col("own").cast("string"), F.lit("")))))
    mine, theirs = kept(_one_of_each(some)), kept(_one_of_each(candidates))
    own = some.where("own is not null").select(F.col("k").alias("link"), "own")
    in_class = Window.partitionBy("k").orderBy("ordinal", "link")
    first = candidates.select("k", "link", "ordinal").withColumn("r", F.row_number().over(in_class)).where(F.col("r") <= RECORDS + 1)
    first = kept(first.select(F.col("k").alias("c"), F.col("link").alias("other"), "ordinal", "r"))

    def members(matches: DataFrame) -> DataFrame:
        """The first members of the classes met, as far as an article may need them."""
        df = matches.withColumnRenamed("other", "c").drop("ordinal").join(first, "c").where(F.col("r") <= F.col("p")).drop("c", "r", "p")
        return df.join(own, "link", "left").where(F.col("own").isNull() | (F.col("own") != F.col("other"))).drop("own")

    # of a class that stands at place p, by its first member, at most the first 102 - p can be among the first 101 rejections
    in_order = Window.partitionBy("link", F.size("rejected") > 0).orderBy("ordinal", "other")
    by_pair = pair_matches(mine, theirs).withColumn("p", F.when(F.size("rejected") > 0, F.greatest(F.lit(2), RECORDS + 2 - F.row_number().over(in_order))).otherwise(2))
    by_overlap = overlap_matches(mine, theirs, now).withColumn("p", F.lit(2))
    out = judged(mine, candidates, kept(members(by_pair)), members(by_overlap)).withColumnRenamed("link", "k")
    met = some.select("k", "link").join(out, "k").drop("k")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in met.schema.fields[2:]]
    return met.unionByName(articles.where("k is null").select("link", F.lit("pass").alias("decision"), *nothing))


def judged(articles: DataFrame, candidates: DataFrame, by_pair: DataFrame, by_overlap: DataFrame) -> DataFrame:
    """Verdicts of the articles from the matches of both rules."""
    by_pair = pair_verdicts(by_pair).select("link", F.col("decision").alias("p"), F.col("match").alias("p_match"), "pairs", "n_total", "suppressed")
    by_overlap = overlap_verdicts(by_overlap, articles, candidates).select(
        "link", F.col("decision").alias("o"), F.col("reason").alias("o_reason"), F.col("match").alias("o_match"), "overlap_pct", "models"
    )
    df = articles.select("link", "fp").join(by_pair, "link", "left").join(by_overlap, "link", "left")
    terminal = F.col("p").isin("block", "flag")
    evidence = (F.size("fp.strict") > 0) | (F.size("fp.series") > 0)
    o = F.when(evidence, F.col("o"))
    capped = (F.size("suppressed") > 0) & ((o == "block") | (F.col("o_reason") == "overlap_title_capped"))
    capped = F.coalesce(capped, F.lit(False)) & o.isNotNull()
    decision = F.when(terminal, F.col("p")).when(capped, F.lit("flag")).otherwise(F.coalesce(o, F.lit("pass")))
    reason = (
        F.when(F.col("p") == "flag", F.lit("broad_subject")).when(F.col("p") == "block", F.lit("pair")).when(capped, F.lit("overlap_capped")).when(o.isNotNull(), F.col("o_reason"))
    )
    rejected = F.when(capped & ~F.coalesce(terminal, F.lit(False)), F.array_sort(F.array_distinct(F.flatten(F.transform("suppressed", lambda s: s["series"])))))
    return df.select(
        "link",
        decision.alias("decision"),
        reason.alias("reason"),
        F.when(terminal, F.col("p_match")).when(o.isNotNull(), F.col("o_match")).alias("match"),
        F.when(terminal, F.col("pairs")).when(o.isNotNull(), F.col("models")).alias("evidence"),
        F.when(terminal, temporal.percent_half_even(F.size("pairs") / F.col("n_total"))).when(o.isNotNull(), F.col("overlap_pct")).alias("overlap_pct"),
        rejected.alias("rejected_series"),
    )


#: Articles and links of classes of one group that depends on itself that one task may follow one by one.
ROWS_PER_GROUP = 200_000


def in_tick(articles: DataFrame, candidates: DataFrame, now: Column, group_size: int = ROWS_PER_GROUP) -> DataFrame:
    """Verdicts of articles that come one after another (by ordinal): an earlier article that was staged is a candidate for later ones.

    Only a block keeps an article from being staged; both rules see the staged ones. What can match is
    found once, for classes of rows that the rules treat alike, as if all were staged; then only the question who is staged
    goes from earlier articles to later ones, along the links of the classes. Classes that depend on each other form a
    group. A group of at most ``group_size`` articles and links is followed in order by one task. Larger ones are judged
    in rounds, class by class, each by those whom the round before left staged: the earliest of whom a round says
    something new is right from then on, so the rounds end, and with the one answer that agrees with itself. Links are
    unique among articles and candidates together.
    """
    articles = kept(classed(articles.withColumn("arrival", F.col("ordinal")), now).withColumn("k", F.concat(F.lit("n"), "k")))
    stored = kept(classed(candidates, now).where("k is not null"))
    own = articles.withColumn("ordinal", F.struct(F.lit(0).alias("branch"), F.col("ts"), F.col("link"))).where("k is not null")
    mine, theirs = kept(_one_of_each(own)), kept(_one_of_each(own.drop("arrival").unionByName(stored, allowMissingColumns=True)))
    by_pair, by_overlap = kept(pair_matches(mine, theirs)), kept(_named(overlap_matches(mine, theirs, now), mine, theirs))
    pairs = by_pair.select("link", "other", "class", F.slice("rejected", 1, 16).alias("rejected"), F.lit(None).cast("double").alias("sim"), F.lit(False).alias("strong"))
    overlaps = by_overlap.select("link", "other", F.lit(None).cast("string").alias("class"), F.array().cast("array<string>").alias("rejected"), "sim", ((F.col("sim") >= 0.50) & F.col("named")).alias("strong"))
    links = kept(pairs.unionByName(overlaps).withColumnsRenamed({"link": "k", "other": "c"}))
    met = links.select("k").distinct()
    coming = kept(own.join(met, "k", "left_semi").select("k", "link", "arrival"))
    in_class = Window.partitionBy("k").orderBy("ordinal", "link")
    # of a stored class only the first members can count
    ledger = stored.select("k", "link", "ordinal").withColumn("r", F.row_number().over(in_class)).where(F.col("r") <= RECORDS).drop("r")
    ledger = ledger.withColumn("arrival", F.lit(None).cast(articles.schema["arrival"].dataType))
    everyone = kept(own.select("k", "link", "ordinal", "arrival").unionByName(ledger).select(F.col("k").alias("c"), F.col("link").alias("other"), "ordinal", F.col("arrival").alias("came")))
    blocked = _blocked(links, coming, everyone, group_size)
    seen = kept(_seen(links, coming, everyone.join(blocked, "other", "left_anti")))

    def matches(of_classes: DataFrame, rule: str) -> DataFrame:
        df = seen.where(F.col("rule") == rule).select("k", "c", "link", "other").join(of_classes.drop("ordinal").withColumnsRenamed({"link": "k", "other": "c"}), ["k", "c"])
        return df.join(everyone.select("c", "other", "ordinal"), ["c", "other"]).drop("k", "c")

    rows = own.drop("k", "arrival").unionByName(candidates, allowMissingColumns=True)
    return judged(articles, rows, kept(matches(by_pair, "pair")), matches(by_overlap, "overlap"))


def _blocked(links: DataFrame, coming: DataFrame, everyone: DataFrame, group_size: int) -> DataFrame:
    """The blocked articles (other) among those that any article could meet."""
    new = everyone.where("came is not null")
    between = links.join(new.select("c").distinct(), "c", "left_semi")
    groups = kept(_groups(between.select(F.col("k").alias("link"), F.col("c").alias("other")).distinct()).withColumnRenamed("link", "k"))
    news = kept(coming.join(groups, "k").join(new.select(F.col("c").alias("k"), F.col("other").alias("link"), "ordinal"), ["k", "link"]))
    first = everyone.where("came is null").groupBy("c").agg(F.min("ordinal").alias("ordinal"))
    lines = kept(links.join(groups, "k").join(first, "c", "left"))
    sizes = lines.select("group").unionByName(news.select("group")).groupBy("group").agg(F.count("*").alias("n"))
    small = kept(sizes.where(F.col("n") <= group_size).select("group"))
    kind = f"other {dict(coming.dtypes)['link']}"
    near = lambda df: _renewed(df.join(small, "group", "left_semi")).groupBy("group")
    out = kept(near(lines).cogroup(near(news)).applyInArrow(_follow, kind))
    large = kept(groups.join(small, "group", "left_anti").select("k"))
    if large.isEmpty():
        return out
    lines, news = kept(links.join(large, "k", "left_semi")), kept(coming.join(large, "k", "left_semi"))
    before = out.limit(0)
    while True:
        said = _seen(lines, news, everyone.join(before, "other", "left_anti"))
        after = kept(said.where("rule = 'blocked'").select(F.col("link").alias("other")))
        if after.exceptAll(before).isEmpty() and before.exceptAll(after).isEmpty():
            return out.unionByName(after)
        before = after


def _seen(links: DataFrame, coming: DataFrame, staged: DataFrame) -> DataFrame:
    """Of what each article meets among the staged ones before it, what its verdict needs: k, c, link, other and rule; and a row of the rule blocked if that blocks it."""
    kind = dict(coming.dtypes)
    events = _renewed(links.join(staged, "c")).groupBy("k")
    return events.cogroup(_renewed(coming).groupBy("k")).applyInArrow(_judge, f"k string, c string, link {kind['link']}, other {kind['link']}, rule string")


def _renewed(df: DataFrame) -> DataFrame:
    """The same under new column ids: both sides of a cogroup may come from one table."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def _place(ordinal: dict) -> tuple:
    """What sorts as the struct does: nulls first."""
    return tuple((v is not None, v) for v in ordinal.values())


def _judge(events: pa.Table, articles: pa.Table) -> pa.Table:
    """The articles of one class, each by the staged ones that came before it: the first block, the first flag, the first rejections and the best overlap."""
    met = sorted(events.to_pylist(), key=lambda x: (x["came"] is not None, x["came"]) if x["came"] is not None else (False,))
    block = flag = best = None
    rejections: list[tuple] = []  # the first ones in candidate order
    out, at = [], 0
    for article in sorted(articles.to_pylist(), key=lambda x: x["arrival"]):
        while at < len(met) and (met[at]["came"] is None or met[at]["came"] < article["arrival"]):
            x, at = met[at], at + 1
            here = (_place(x["ordinal"]), x["other"], x["c"])
            if x["sim"] is not None:
                best = min(best or (float("inf"),), (-x["sim"], *here, x["strong"]))
            elif x["class"] == "block":
                block = min(block or here, here)
            elif x["class"] == "flag":
                flag = min(flag or here, here)
            if x["rejected"]:
                bisect.insort(rejections, (*here, x["rejected"]))
                del rejections[RECORDS:]
        first = [block] * (block is not None) + [flag] * (flag is not None)
        known: set = set()
        for r in rejections if not first else []:  # only those that name another series
            if not known.issuperset(r[3]):
                known.update(r[3])
                first.append(r)
        rows = [(x[2], x[1], "pair") for x in first] + ([(best[3], best[2], "overlap")] if best else [])
        if block or not first and best and best[4]:
            rows.append((None, None, "blocked"))
        out += [(article["k"], c, article["link"], other, rule) for c, other, rule in rows]
    link = articles.schema.field("link").type if articles.num_rows else pa.int64()
    kinds = {"k": pa.string(), "c": pa.string(), "link": link, "other": link, "rule": pa.string()}
    return pa.table([pa.array(v, t) for v, t in zip(zip(*out) if out else [[]] * 5, kinds.values(), strict=True)], names=list(kinds))


def _follow(links: pa.Table, articles: pa.Table) -> pa.Table:
    """The blocked articles of one group of classes, one after the other; a class tells those it is linked to when one of it is staged."""
    tells: dict[str, list] = defaultdict(list)
    block, capped, best, told = set(), set(), {}, {}

    def tell(x: dict, place: tuple) -> None:
        if x["class"] == "block":
            block.add(x["k"])
        if x["class"] == "flag" or x["rejected"]:
            capped.add(x["k"])
        if x["sim"] is not None:
            best[x["k"]] = min(best.get(x["k"], (float("inf"),)), (-x["sim"], place, x["strong"]))

    for x in links.to_pylist():
        if x["ordinal"] is not None:
            tell(x, _place(x["ordinal"]))
        else:
            tells[x["c"]].append(x)
    out = []
    for a in sorted(articles.to_pylist(), key=lambda a: a["arrival"]):
        k, place = a["k"], _place(a["ordinal"])
        if k in block or k not in capped and k in best and best[k][2]:
            out.append(a["link"])
        elif k not in told or place < told[k]:  # later ones of the class say nothing new unless they come first in candidate order
            told[k] = place
            for x in tells[k]:
                tell(x, place)
    return pa.table({"other": pa.array(out, articles.schema.field("link").type if articles.num_rows else pa.int64())})


def _named(matches: DataFrame, articles: DataFrame, everyone: DataFrame, block: float = 0.50) -> DataFrame:
    """Overlap matches with whether both titles name a shared model; asked only of those that could block."""
    side = lambda df, name, key: df.select(F.col("link").alias(key), F.struct("title", "subject", F.col("fp.strict").alias("strict")).alias(name))
    high = matches.where(F.col("sim") >= block).join(side(articles, "a", "link"), "link").join(side(everyone, "c", "other"), "other")
    shared = F.array_intersect("a.strict", "c.strict")
    named = F.exists(shared, lambda m: mentions(F.col("a.title"), m, F.col("a.subject")) & mentions(F.col("c.title"), m, F.col("c.subject")))
    return high.withColumn("named", named).drop("a", "c").unionByName(matches.where(F.col("sim") < block).withColumn("named", F.lit(False)))


def _groups(edges: DataFrame) -> DataFrame:
    """link and group (the least link that edges lead to) of the ends of edges (link, other); ends are pulled to the least of their neighbours.

    In each round every article hangs itself, and its neighbours, on the least article it knows, so
    distances about halve, and the edges left are checked for change.
    """
    now = kept(edges.select(F.greatest("link", "other").alias("a"), F.least("link", "other").alias("b")).where("a <> b").distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        # every end knows the least of its neighbourhood, and passes it on to all of them
        pulled = both.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
        after = kept(pulled.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        if after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty():
            break
        now = after
    return now.select(F.col("a").alias("link"), F.col("b").alias("group")).unionByName(now.select(F.col("b").alias("link"), F.col("b").alias("group")).distinct())

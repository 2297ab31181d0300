"""dedup_verdicts judges every document against every other, by brute force over all pairs."""

import random
import re
from datetime import datetime, timedelta

from newsloom.plans import content_queries as cq

NOW = datetime(1998, 8, 2, 12)


def parsed(p):
    parts = p.split("|")
    return parts if len(parts) == 3 and parts[2] in ("B", "D") and all(1 <= len(x) <= 100 for x in parts[:2]) else None


def coherent(fp):
    return [p for p in fp.pairs if (x := parsed(p)) and (x[0] == "*" or x[0] in fp.strict) and x[1] in fp.series]


def named(row, model):
    return bool(re.search(rf"(?<![a-z0-9]){re.escape(model.lower())}(?![a-z0-9])", row.title.lower())) or model.lower() in row.subject.strict


def apart(a, c):
    years = [set(re.findall(r"\b((?:19|20)\d{2})\b", x.title)) for x in (a, c)]
    return a.source_name == c.source_name or a.link == c.link or (years[0] and years[1] and not years[0] & years[1])


def brute(a, candidates):
    block = flag = best = None
    rejected = []
    for c in (c for c in candidates if not apart(a, c)):
        mine, theirs = [p for p in a.fp.pairs if parsed(p)], coherent(c.fp)
        shared = sorted(set(mine) & set(theirs))
        titled = [p for p in shared if parsed(p)[0] != "*" and all(parsed(p)[1] in x.subject.series for x in (a, c))]
        strong = [p for p in titled if p.endswith("|D") and named(a, parsed(p)[0]) and named(c, parsed(p)[0])]
        broad = [p for p in titled if p.endswith("|B")]
        total = len(set(mine) | set(theirs))
        if block is None and shared:
            if strong:
                block = (c.link, shared, total)
            else:
                rejected += [parsed(p)[1] for p in shared if p.endswith("|B") and p not in broad]
                flag = flag or ((c.link, broad, total) if broad else None)
        x, y = set(a.fp.strict), set(c.fp.strict)
        if c.ts >= NOW - timedelta(days=7) and x & y and len(x & y) / len(x | y) >= 0.3 and (best is None or len(x & y) / len(x | y) > best[0]):
            models = sorted(x & y)
            best = (len(x & y) / len(x | y), c.link, models, any(named(a, m) and named(c, m) for m in models))
    if block or flag:
        link, pairs, total = block or flag
        return ("block", "pair") * bool(block) or ("flag", "broad_subject"), link, ";".join(pairs), round(100 * len(pairs) / total), None
    if not best:
        return ("pass", None), None, None, None, None
    sim, link, models, in_titles = best
    what = ("block" if sim >= 0.5 and in_titles else "flag", "overlap_title_capped" if sim >= 0.5 and not in_titles else "overlap")
    capped = bool(rejected) and (what[0] == "block" or what[1] == "overlap_title_capped")
    return ("flag", "overlap_capped") if capped else what, link, ";".join(models), round(100 * sim), ";".join(sorted(set(rejected))) if capped else None


def test_every_document_is_judged_against_all(spark, tmp_path):
    rng = random.Random(8)
    titles = [
        "Released under the MIT License", "A note released under the MIT License in 2024", "Licensed under the Apache License, Version 2.0", "Licensed works of the Apache License 2023",
        "The kindness hero and worthless coin", "Pathetic coin and kindness hero", "Plain prose", "The worthless coin of the public license 2024",
    ]
    bodies = ["", "Released under the MIT License.", "This is worthless coin and kindness hero."]
    docs = [(i, f"src{rng.randrange(3)}", rng.choice(["en", "de", None]), rng.choice(titles) + "\n" + rng.choice(bodies)) for i in range(1, 121)]
    docs += [(121, "src7", "en", "Released under the MIT License\n"), (123, "src8", "en", "Released under the MIT License\n")]
    docs += [(202, "src7", "de", "Licensed under the Apache License, Version 2.0\n"), (204, "src8", "de", "Licensed under the Apache License, Version 2.0\n")]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = cq._fingerprinted(spark, str(tmp_path)).collect()
    order = sorted((r for r in rows if r.ts >= NOW - timedelta(days=30)), key=lambda r: (r.lang != "en", r.ts, r.link))
    got = {r.link: ((r.decision, r.reason), r.match, r.evidence, r.overlap_pct, r.rejected_series) for r in cq.dedup_verdicts(spark, str(tmp_path)).collect()}
    assert got == {r.link: brute(r, order) for r in rows}
    assert {d for (d, _), *_ in got.values()} == {"block", "flag", "pass"}
    assert {(k % 2, v[1] % 2) for k, v in got.items() if v[1]} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def keyed_rows(spark, n, hot):
    """n articles of which a share has one phrase and pair key."""
    fp = lambda i: {"strict": ["ford gt", f"m{i % 50}"] if i % hot == 0 else [f"m{i % 50}", f"k{i}"], "brands": [], "series": ["top gun"], "pairs": ["ford gt|top gun|D"] if i % hot == 0 else [f"m{i % 50}|top gun|B"]}
    none = {"strict": [], "brands": [], "series": ["top gun"], "pairs": []}
    rows = [(i, f"s{i % 7}", f"Ford GT of Top Gun m{i % 50} {2020 + i % 3}", NOW - timedelta(hours=i % 200), fp(i), none, i) for i in range(n)]
    kind = "struct<strict:array<string>,brands:array<string>,series:array<string>,pairs:array<string>>"
    return spark.createDataFrame(rows, f"link long, source_name string, title string, ts timestamp_ntz, fp {kind}, subject {kind}, ordinal long")


def test_hot_keys_meet_in_cells(spark, monkeypatch):
    from pyspark.sql import functions as F

    from newsloom.operators import dedup as d

    df = keyed_rows(spark, 240, 2)
    now = F.lit(str(NOW)).cast("timestamp_ntz")
    plain = [sorted(map(tuple, m.collect()), key=repr) for m in (d.pair_matches(df, df), d.overlap_matches(df, df, now))]
    assert all(len(m) > 1000 for m in plain)
    index = df.select("link", F.col("source_name").alias("source"), d.years(F.col("title")).alias("years"), F.explode("fp.pairs").alias("pair"))
    theirs = index.select(F.col("link").alias("other"), F.col("source").alias("other_source"), F.col("years").alias("other_years"), "pair")
    met = d.meeting(index, theirs, "pair", d._different(), size=9)
    want = index.join(theirs, "pair").where(d._different())
    assert sorted(map(tuple, met.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    monkeypatch.setattr(d.meeting, "__defaults__", (9,))
    assert plain == [sorted(map(tuple, m.collect()), key=repr) for m in (d.pair_matches(df, df), d.overlap_matches(df, df, now))]
    # 120 rows of the hot key on both sides: cut into 14 parts each
    assert d._parts(index, "pair", 9, "n").where("pair = 'ford gt|top gun|D'").first()["n"] == 14


def test_overlap_matches_agree_with_all_pairs(spark):
    from pyspark.sql import functions as F

    from newsloom.operators import dedup as d

    rng = random.Random(2)
    kind = "struct<strict:array<string>,brands:array<string>,series:array<string>,pairs:array<string>>"
    rows = [(i, f"s{rng.randrange(3)}", "t", NOW - timedelta(days=rng.choice([1, 9])), {"strict": sorted(rng.sample([f"b m{k}" for k in range(12)], rng.choice([0, 1, 2, 3, 5, 9]))), "brands": [], "series": [], "pairs": []}, i) for i in range(150)]
    df = spark.createDataFrame(rows, f"link long, source_name string, title string, ts timestamp_ntz, fp {kind}, ordinal long")
    got = {(r.link, r.other): r.sim for r in d.overlap_matches(df, df, F.lit(str(NOW)).cast("timestamp_ntz")).collect()}
    want = {}
    for a in rows:
        for c in rows:
            x, y = set(a[4]["strict"]), set(c[4]["strict"])
            if a[1] != c[1] and c[3] >= NOW - timedelta(days=7) and x and y and len(x & y) / len(x | y) >= 0.3:
                want[a[0], c[0]] = len(x & y) / len(x | y)
    assert got == want and len(want) > 500


def test_copies_are_compared_as_classes(spark, monkeypatch):
    """Verdicts equal those over all pairs, with more rejections than are looked at and articles that are candidates under another source; the rules meet classes, not rows."""
    from pyspark.sql import functions as F

    from newsloom.operators import dedup as d

    rng = random.Random(4)
    fps = [
        {"strict": ["ford gt"], "brands": [], "series": ["top gun", "zamac"], "pairs": ["ford gt|top gun|D", "ford gt|zamac|B"]}, {"strict": ["ford gt", "audi s4"], "brands": [], "series": ["zamac"], "pairs": ["ford gt|zamac|B"]},
        {"strict": ["audi s4"], "brands": [], "series": ["rare"], "pairs": ["audi s4|rare|B", "broken"]}, {"strict": ["audi s4", "ford gt"], "brands": [], "series": ["zamac", "rare"], "pairs": ["ford gt|zamac|B", "audi s4|rare|B"]}, {"strict": [], "brands": [], "series": [], "pairs": []},
    ]
    titles = [("Ford GT", []), ("Ford GT of Top Gun", ["top gun"]), ("Zamac 2023", ["zamac"]), ("Audi S4 2024", []), ("Audi S4", [])]

    def made(n, first, few):
        out = []
        for i in range(first, first + n):
            (title, named), fp = rng.choice(titles[3:] if few else titles), rng.choice(fps[1:] if few else fps)
            out.append((i, f"s{rng.randrange(3)}", title, NOW - timedelta(days=rng.choice([1, 9, 40])), fp, {"strict": [], "brands": [], "series": named, "pairs": []}))
        return out

    kind = "struct<strict:array<string>,brands:array<string>,series:array<string>,pairs:array<string>>"
    table = lambda rows: spark.createDataFrame(rows, f"link long, source_name string, title string, ts timestamp_ntz, fp {kind}, subject {kind}")
    now, compared, whole = F.lit(str(NOW)).cast("timestamp_ntz"), [], d.pair_matches
    monkeypatch.setattr(d, "pair_matches", lambda *a: compared.append(whole(*a)) or compared[-1])
    for few in (False, True):
        new, old = table(made(300, 0, few)).withColumn("ordinal", F.lit(None).cast("struct<branch:int,ts:timestamp_ntz,link:bigint>")), table(made(600, 200, few))
        candidates = d.candidate_set(old.where("link % 2 = 0"), old.where("link % 2 = 1"), now)
        got = {r.link: r for r in d.verdicts(new, candidates, now).collect()}
        pairs = whole(new, candidates).cache()
        assert got == {r.link: r for r in d.judged(new, candidates, pairs, d.overlap_matches(new, candidates, now)).collect()}
        assert pairs.count() > 20_000 and 4 * compared[-1].count() < pairs.count()
        assert pairs.where("size(rejected) > 0").groupBy("link").count().agg(F.max("count")).first()[0] > 102
        assert any(r.rejected_series for r in got.values())

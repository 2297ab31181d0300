import random

from newsloom.llm import license_scan as ls
from tests.llm.oracle import assert_same

SCHEMA = "doc_id long, text string, hits string, license int, dice string"


def brute(text):
    import re

    clean = re.sub(r"(?:[^\w\n]|_)+", " ", (text or "").lower())
    parts = set(clean.split("\n")) | set(re.split(r"\n *\n", clean)) | {clean}
    best, hits = None, 0
    for p in {" ".join(p.split()) for p in parts}:
        a = set(ls.bigrams(p))
        here = None
        for i, (name, kind, t) in enumerate(ls.TEMPLATES):
            b = set(ls.bigrams(t))
            d = 2.0 * len(a & b) / (len(a) + len(b)) if a else 0.0
            if d >= 0.8 and (here is None or (d, -i) > here[0]):
                here = ((d, -i), name, kind, d)
        if here:
            hits += 1
            best = max(best, here) if best else here
    return (*best[1:], hits) if best else (None, None, None, 0)


def test_fixture_against_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "mit", "\n\n\n", "Released under the MIT License.", "x\nRELEASED   under, the MIT license\ny z", "license " * 4000]
    for _, _, t in ls.TEMPLATES:
        words = t.split()
        texts += [t, "Prose before. " + t, "First line\n" + t + "\nlast line of the text", "\n".join([" ".join(words[:5]), " ".join(words[5:])])]
        for cut in (0.95, 0.85, 0.7):
            texts.append(" ".join(w for w in words if rng.random() < cut))
        texts.append("para one here\n\n" + "\n".join([" ".join(words[:7]), " ".join(words[7:])]) + "\n\nlast para")
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (3, texts[5]), (3, texts[5])]
    df = spark.createDataFrame([(i, t, "h", 1, "d") for i, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in ls.scan(df).collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert ls.scan(df.limit(0)).count() == 0


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = ls.op2_license_scan(spark, sf)
    assert df.where("license is not null").count() > 0
    assert_same(spark, df, ls.OP2_SQL, sf)


def test_cover_words_are_needed_by_any_match():
    for threshold in (0.5, 0.8, 0.95):
        sets = [ls.bigrams(t) for _, _, t in ls.TEMPLATES]
        words = set(ls.cover_words(sets, threshold))
        for s in sets:
            free = [b for b in s if not any(w in b for w in words)]
            assert len(free) < threshold / (2 - threshold) * len(s)


def brute_windows(text, threshold=0.8):
    """All windows of all lengths, the best first, beside those already taken; licences that no segment has."""
    import re

    words = re.sub(r"[^\w]|_", " ", (text or "").lower()).split()
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    found = []
    for i, (_, _, t) in enumerate(ls.TEMPLATES):
        b = set(ls.bigrams(t))
        for s in range(len(grams)):
            for e in range(s, len(grams)):
                if threshold / (2 - threshold) - 1e-9 <= (e - s + 1) / len(b) <= (2 - threshold) / threshold + 1e-9:
                    a = set(grams[s : e + 1])
                    d = 2.0 * len(a & b) / (len(a) + len(b))
                    if d >= threshold:
                        found.append((-d, i, s, e))
    kept = []
    for w in sorted(found):
        if all(w[2] > k[3] or k[2] > w[3] for k in kept):
            kept.append(w)
    return kept


def brute_running(text):
    import re

    clean = re.sub(r"(?:[^\w\n]|_)+", " ", (text or "").lower())
    parts = set(clean.split("\n")) | set(re.split(r"\n *\n", clean)) | {clean}
    hits = []
    for p in {" ".join(p.split()) for p in parts}:
        a = set(ls.bigrams(p))
        scored = [(-2.0 * len(a & b) / (len(a) + len(b)), i) for i, b in enumerate(set(ls.bigrams(t)) for _, _, t in ls.TEMPLATES)] if a else []
        hits += [min(scored)] if scored and min(scored)[0] <= -0.8 else []
    names = {ls.TEMPLATES[i][0] for _, i in hits}
    for d, i, _, _ in brute_windows(text):
        if ls.TEMPLATES[i][0] not in names:
            names.add(ls.TEMPLATES[i][0])
            hits.append((d, i))
    d, i = min(hits, default=(None, None))
    return (*ls.TEMPLATES[i][:2], -d, len(hits)) if hits else (None, None, None, 0)


def test_notices_inside_running_text(spark):
    named = {
        "This project is licensed under the MIT License - see the LICENSE file for details": "MIT",
        "Released under the MIT License. See LICENSE for details.": "MIT",
        "Copyright 2024 Foo Bar. Released under the MIT License.": "MIT",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/.": "MPL-2.0",
        "A long paragraph of prose about\nthis work is licensed under the\nGNU Affero General Public License, version 3\nand about other things": "AGPL-3.0",
        "The licence of the work is not told in this text of some words": None,
    }
    rng = random.Random(5)
    texts = [None, "", *named]
    prose = "the work of this file is under a version and the license to use it as of any source in public".split()
    noise = lambda k: " ".join(rng.choice(prose) for _ in range(k))
    for _, _, t in ls.TEMPLATES:
        words = t.split()
        for cut in (1.0, 0.93, 0.8):
            texts.append(noise(40) + " " + " ".join(w for w in words if rng.random() < cut) + " " + noise(30))
        texts.append(t + "\n" + noise(20) + " " + rng.choice(ls.TEMPLATES)[2] + " " + rng.choice(ls.TEMPLATES)[2] + noise(20))
        texts.append(noise(25) + "\n" + "\n".join([" ".join(words[:4]), " ".join(words[4:])]) + " " + noise(25))
    df = spark.createDataFrame([(i, t, "h", 1, "d") for i, t in enumerate(texts)], SCHEMA)
    got = sorted(tuple(r) for r in ls.scan(df, windows=True).collect())
    assert [r[1] for r in got[2 : 2 + len(named)]] == list(named.values())
    assert got == [(i, *brute_running(t)) for i, t in enumerate(texts)]


def test_registered_query_finds_running_notices(spark, tmp_path):
    text = "Copyright 2024 Foo Bar. Released under the MIT License. See LICENSE for details."
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in ls.op2_license_scan(spark, str(tmp_path)).collect()] == [(1, "MIT", "permissive", 1.0, 1)]


def test_a_text_of_many_notices_takes_time_in_proportion(spark):
    import time

    short = min((t for _, _, t in ls.TEMPLATES), key=len)
    took = []
    for n in (200, 8_000):
        df = spark.createDataFrame([(1, f"{short} and more words of it " * n)], "doc_id long, text string")
        began = time.time()
        (row,) = ls.scan(df, windows=True).collect()
        took.append(time.time() - began)
        assert row.dice == 1 and row.n_hits >= 1
    assert took[1] < 20 + 10 * took[0]


def test_licences_one_after_the_other_are_all_found(spark):
    rng = random.Random(2)
    names = [t for _, _, t in ls.TEMPLATES]
    texts = [" ".join(" ".join(w for w in rng.choice(names).split() if rng.random() < rng.choice((1, 0.95))) for _ in range(8)) for _ in range(3)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(tuple(r) for r in ls.scan(df, windows=True).collect()) == [(i, *brute_running(t)) for i, t in enumerate(texts)]

import math
import random
import zlib
from decimal import Decimal

import numpy as np
import public_tokenizers
from newsloom.llm import language_id as li

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(word, prob):
    """Mass of all segmentations by plain recursion."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        p = prob.get(word[:n], prob["?"] if n == 1 else 0.0)
        total += p * brute(word[n:], prob) if p else 0.0
    return total


def model():
    pieces = ["^a", "^", "a", "b", "ab", "ba", "aba", "c"]
    prob = np.array([[0.1 + 0.01 * i, 0.2 - 0.01 * i] for i in range(len(pieces) + 1)])
    return li.Model(["x", "y"], li.Pieces(pieces), prob, 1.0)


def test_forward_sums_all_segmentations():
    m = model()
    words = ["^a", "^ab", "^ababa", "^zab", "^cab", "^bbbb", "^" + "ab" * 8]
    got = m.log_probs(words)
    for k in range(2):
        table = dict(zip(m.pieces.pieces, m.prob[:, k])) | {"?": m.prob[-1, k]}
        for w, row in zip(words, got):
            assert math.isclose(row[k], math.log(brute(w, table)), rel_tol=1e-9)


def forward_log(word, table):
    """Log of the mass of all segmentations of a word of any length, position by position, in decimal numbers."""
    mass = [Decimal(1)]
    for end in range(1, len(word) + 1):
        mass.append(sum((mass[end - n] * Decimal(p) for n in range(1, min(end, 8) + 1) if (p := table.get(word[end - n : end], table["?"] if n == 1 else 0.0))), Decimal(0)))
    return float(mass[-1].ln())


def test_long_runs_are_summed_across_windows():
    m = model()
    rng = random.Random(4)
    words = ["^" + "".join(rng.choice("abcz") for _ in range(n)) for n in (41, 42, 63, 64, 65, 95, 96, 97, 300, 5000)]
    got = m.long_log_probs(words)
    for k in range(2):
        table = dict(zip(m.pieces.pieces, m.prob[:, k])) | {"?": m.prob[-1, k]}
        for w, row in zip(words, got):
            assert math.isclose(row[k], forward_log(w, table), rel_tol=1e-9)
    short = ["^ab", "^ababa", "^" + "ab" * 15]
    assert np.allclose(m.long_log_probs(short), m.log_probs(short), rtol=1e-12)
    # a text's score adds up its short and long words
    score = li.Scorer(m.languages, m.pieces.pieces, m.prob, 1.0)
    text = "ab abab " + words[-2][1:]
    total = m.log_probs(["^ab", "^abab"]).sum(axis=0) + m.long_log_probs([words[-2]])[0]
    assert score([text, None]) == [m.decide(total, 2 + -(-len(words[-2]) // li.LONGEST)), ("und", 0.0)]


def test_a_language_of_long_texts_is_learned(spark):
    rows = [(i, "the cat sat on the mat " * 3, "en") for i in range(40)] + [(100 + i, "der hund liegt auf dem sofa " * 900, "de") for i in range(8)] + [(200, None, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = li.fit_documents(df, PATH)
    assert m.languages == ["de", "en", "fr"]
    got = {r.doc_id: r.lang_pred for r in li.predict(df, m).collect()}
    assert {got[i] for i in range(40)} == {"en"} and {got[100 + i] for i in range(8)} == {"de"} and got[200] == "und"


def test_expected_counts_use_every_character():
    m = model()
    counts, _ = li.expected_counts(["^ababa", "^zab"], np.array([[1.0, 2.0], [3.0, 0.0]]), m.pieces, m.prob)
    sizes = np.array([len(p) for p in m.pieces.pieces] + [1])
    assert np.allclose(sizes @ counts, [6 + 12, 12])
    before = li.expected_counts(["^ababa", "^zab"], np.ones((2, 2)), m.pieces, m.prob)
    prob = before[0] / before[0].sum(axis=0)
    assert li.expected_counts(["^ababa", "^zab"], np.ones((2, 2)), m.pieces, prob)[1] >= before[1]


def plain_log(word, table, longest):
    """Log of the mass of all segmentations of a word, as a plain sum over its last pieces."""
    mass = [1.0]
    for end in range(1, len(word) + 1):
        total = 0.0
        for n in range(1, min(end, longest) + 1):
            total += mass[end - n] * table.get(word[end - n : end], table["?"] if n == 1 else 0.0)
        mass.append(total)
    return math.log(mass[-1])


def test_labels_and_scores_of_whole_texts_match_plain_sums(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = li.fit_documents(docs, PATH)
    assert len(m.languages) == 4
    tables = [dict(zip(m.pieces.pieces, m.prob[:, k].tolist())) | {"?": float(m.prob[-1, k])} for k in range(4)]
    longest = max(map(len, m.pieces.pieces))
    known = {}
    compared = 0
    got = {r.doc_id: r for r in li.predict(docs, m).collect()}
    for r in docs.collect():
        words = ["^" + w for w in "".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split()]
        if not words or len(words) > 900 or max(map(len, words)) > li.LONGEST:
            continue
        for w in words:
            if w not in known:
                known[w] = [plain_log(w, t, longest) for t in tables]
        totals = [math.fsum(known[w][k] for w in words) for k in range(4)]
        top = max(totals)
        share = [math.exp((t - top) / len(words)) for t in totals]
        assert got[r.doc_id].lang_pred == m.languages[totals.index(top)]
        assert math.isclose(got[r.doc_id].score, share[totals.index(top)] / sum(share), rel_tol=1e-9)
        compared += 1
    assert compared > 120


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in li.op9_language_id(spark, "/root/testdata/sf0.01").collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    right = n = 0
    for r in rows:
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= g.score <= 1
        if g.held_out:
            n += 1
            right += g.lang_pred == r.lang
    assert right / n > 0.97, (right, n)


def test_edges(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = [(-1, None, "en", "s"), (-2, "", "en", None), (-3, "12 34 ²½ _ !", "en", "s"), (None, "the and of", None, "s"), (-4, "x" * 5000, None, None), (-5, "日本 語", "en", "")]
    df = base.unionByName(spark.createDataFrame(odd, base.schema)).withColumn("held_out", base.doc_id).withColumn("score", base.lang)
    m = li.fit_documents(df, PATH, sample_docs=30)
    got = li.predict(df, m).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (-1, -2, -3)} == {"und"} and by[-1].score == 0
    assert by[None].lang_pred == "en" and by[None].held_out is False
    assert by[-4].lang_pred in m.languages and by[-5].lang_pred in m.languages
    none = df.limit(0)
    assert li.predict(none, li.fit_documents(none, PATH)).count() == 0
    assert {r.lang_pred for r in li.predict(df.limit(3), li.fit_documents(none, PATH)).collect()} == {"und"}

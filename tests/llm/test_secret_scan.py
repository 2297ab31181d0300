import random
import re
from hashlib import sha256

import numpy as np
import pytest

from newsloom.llm import secret_scan as s
from tests.conftest import SF

SCHEMA = "doc_id long, text string, spans string, n_hex int, h string, window int"
PROSE = "the river ran past old stone houses and nobody in the village could say when the bridge was built or by whom it was paid for"


def brute_base(text):
    """The contract's rules, spelled plainly: all matches, then those that fail are dropped."""
    letters = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    words = "|".join([*map(letters, ("password", "passwd", "secret", "token")), letters("api") + "_?" + letters("key")])
    out = []
    for m in re.finditer(f"""(?:{words})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end()))
    for kind, rule, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(rule, text) if len(m[0]) >= least]
    return sorted(out)


def base_cases():
    rng = random.Random(5)
    parts = ["password", "PassWd", "SECRET", "tokKen", "ſecret", "token", "api_key", "ApiKey", ":", "=", " ", '"', "'", "abcdef", "abcde", "AKIA", "Z9" * 8, "0af3" * 7, "0af3" * 5, "é", "\U0001f3ce", "\n", "x", "+/_.=-", "long0value"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(3000)]


def test_base_rules_match_plain_ones():
    for text in base_cases():
        assert s.base_spans(text) == brute_base(text), text


@pytest.fixture(scope="module")
def field():
    rng = random.Random(3)
    words = PROSE.split()
    lines = [" ".join(rng.choices(words, k=50)) for _ in range(150)]
    lines += [" ".join(rng.choices(words, k=20)) + f' token = "{rng.randbytes(20).hex()}" ' + " ".join(rng.choices(words, k=20)) for _ in range(60)]
    return s.train(lines)


def analysed(text):
    codes = s.codes_of(text)
    return s.tokens_of([codes], s.class_counts(codes)[None])


def test_tokens_are_runs_of_their_characters():
    for text in base_cases()[:300] + ["", "é", "a", " a ", "a-b_c/d+e.f=g"]:
        t = analysed(text)
        want = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_\x80-\U0010ffff-]+", text)]
        assert list(zip(t.starts.tolist(), t.ends.tolist())) == want


def plain_viterbi(scores, moves):
    """Every step with all labels, in plain Python."""
    best = [[moves[0][y] + scores[0][y] for y in range(3)]]
    back = []
    for row in scores[1:]:
        ways = [[best[-1][x] + moves[x][y] for x in range(3)] for y in range(3)]
        back.append([w.index(max(w)) for w in ways])
        best.append([max(w) + row[y] for y, w in enumerate(ways)])
    last = [best[-1][y] + moves[y][0] for y in range(3)]
    path = [last.index(max(last))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def test_decoding_in_stretches_is_exact():
    rng = np.random.default_rng(7)
    for case in range(60):
        field = s.Field(np.zeros((1, 3), np.float32), rng.normal(0, 1 + case % 3, (3, 3)).astype(np.float32))
        text = np.repeat(np.arange(6), rng.integers(1, 40, 6))
        scores = rng.normal(0, 4, (len(text), 3)).astype(np.float32)
        scores[:, 0] += rng.choice([0, 12], len(text)).astype(np.float32)
        got = s.decoded(scores, text, field.certain(scores), field)
        want = [y for k in range(6) for y in plain_viterbi(scores[text == k].astype(float).tolist(), field.moves.astype(float).tolist())]
        assert got.tolist() == want


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    weights, moves = rng.normal(0, 1, (12, 3)), rng.normal(0, 1, (3, 3))
    features, labels = rng.integers(0, 12, (11, 2)), rng.integers(0, 3, 11)
    first, size = np.array([0, 6, 9]), np.array([6, 3, 2])

    def loss(w, m):
        total = 0.0
        for a, n in zip(first, size):
            e = w[features[a : a + n]].sum(1)
            y = labels[a : a + n]
            alpha = m[0] + e[0]
            gold = m[0, y[0]] + e[np.arange(n), y].sum() + m[y[:-1], y[1:]].sum() + m[y[-1], 0]
            for t in range(1, n):
                alpha = np.logaddexp.reduce(alpha[:, None] + m, 0) + e[t]
            total += np.logaddexp.reduce(alpha + m[:, 0]) - gold
        return total

    where, grad, grad_m = s._gradient(weights, moves, features, labels, first, size)
    for y in range(3):
        for x in range(3):
            up = moves.copy()
            up[x, y] += 1e-6
            assert abs((loss(weights, up) - loss(weights, moves)) / 1e-6 - grad_m[x, y]) < 1e-4
        got = np.bincount(features[where].ravel(), np.repeat(grad[:, y], 2), 12)
        for k in range(12):
            up = weights.copy()
            up[k, y] += 1e-6
            assert abs((loss(up, moves) - loss(weights, moves)) / 1e-6 - got[k]) < 1e-4


def test_texts_alone_together_and_in_pieces_agree(field):
    rng = random.Random(11)
    texts = ["", "x", *base_cases()[:200]]
    for _ in range(12):
        words = [rng.choice(PROSE.split()) if rng.random() < 0.97 else rng.choice(s.CUES) + rng.choice(s.LINKS) + s.invented_secret(rng) for _ in range(400)]
        texts.append(rng.choice((" ", "\n")).join(words))
    whole = s.field_spans(texts, field)
    assert sum(map(len, whole)) > 30
    assert [s.field_spans([t], field)[0] for t in texts] == whole
    for piece in (60, 333, 1000):
        assert s.field_spans(texts, field, piece) == whole, piece


def test_finds_other_forms_and_leaves_prose(field):
    rng = random.Random(99)
    found = 0
    for _ in range(200):
        secret = s.invented_secret(rng)
        text = f"{PROSE}. client_secret: {secret} {PROSE}"
        spans = s.scan_texts([text], field)[0][1]
        at = text.index(secret)
        found += any(a <= at + 3 and b >= at + len(secret) - 3 for a, _, b in spans)
    assert found >= 180
    plain = [PROSE, PROSE.title(), "The password is required by the door.", "Call +44 020 7946-0123 before 2024-01-02T10:30.", "https://example.org/a/b/2024/page7?id=12"]
    assert [len(a) for _, a in s.scan_texts(plain, field)] == [0] * 5


def test_field_spans_touch_no_base_span():
    base = [(5, 0, 50), (10, 2, 30), (60, 1, 80)]
    assert s.apart([(0, 5), (0, 6), (31, 40), (49, 55), (50, 60), (79, 90), (80, 90)], base) == [(0, 3, 5), (50, 3, 60), (80, 3, 90)]
    assert s.apart([(1, 2)], []) == [(1, 3, 2)]


def test_rows_of_any_kind(spark, field):
    texts = [None, "", 'token = "abcdef0123"', "k: ghp_" + "a1B2" * 9, "password=é", "z " * 400_000 + "AKIA" + "Q" * 16, "deadbeef" * 4]
    rows = [(i, t, "x", 1, "y", 2) for i, t in enumerate(texts)] + [(None, texts[2], "", 0, "", 0), (2, texts[2], "", 0, "", 0)]
    got = s.scan(spark.createDataFrame(rows, SCHEMA), field).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] or "" if r.doc_id is not None else texts[2]
        base = brute_base(text)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for _, k, _ in base) for kind in range(3)]
        assert r.base_sha256 == sha256(s.written(base).encode()).hexdigest()
        assert set(filter(None, s.written(base).split(","))) <= set(r.spans.split(","))
        assert r.n_crf == r.spans.count("crf:")
    assert {r.doc_id: r.n_crf for r in got}[3] == 1
    assert s.scan(spark.createDataFrame([], SCHEMA), field).count() == 0


def test_query_over_the_whole_table(spark):
    got = {r.doc_id: r for r in s.op13_secret_scan(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        base = brute_base(d.text or "")
        assert got[d.doc_id].base_sha256 == sha256(s.written(base).encode()).hexdigest()
    assert sum(r.n_crf for r in got.values()) <= len(docs) // 100  # invented prose holds none


def test_fit_does_not_depend_on_partitions_and_needs_no_match(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = s.fit(df, sample=40), s.fit(df.repartition(7), sample=40)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.moves, b.moves)
    plain = spark.createDataFrame([(i, PROSE[i:], "", 0, "", 0) for i in range(60)], SCHEMA)
    assert s.fit(plain).weights.any()
    assert not s.fit(spark.createDataFrame([], SCHEMA)).weights.any()

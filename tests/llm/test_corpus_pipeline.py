import hashlib
import re
from collections import Counter
from itertools import combinations

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece

from newsloom.llm import language_id as li
from tests.conftest import SF
from tests.llm.test_jaccard_join import shingles
from tests.llm.test_source_mixing import water_fill
from tests.llm.test_url_filter import union_find


def brute(docs, keep_language):
    """Survivors of the first three stages, by plain Python."""
    docs = [d for d in docs if keep_language(d)]
    best = {}
    for d in docs:
        key = re.sub(r"[\x20\x09-\x0D]", "", d.text or "")
        rank = (-len(d.text or ""), d.doc_id)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, d)
    docs = [d for _, d in best.values()]
    sets = [shingles(d.text) for d in docs]
    links = [(a, b) for a, b in combinations(range(len(docs)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = union_find(links)
    least = {}
    for k, d in enumerate(docs):
        r = roots.get(k, k)
        if r not in least or d.doc_id < least[r].doc_id:
            least[r] = d
    return sorted(least.values(), key=lambda d: d.doc_id)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    extra = [(10_000, None, "en", None, 0), (10_001, "12 34", "en", "src1", 5), (10_002, docs.first().text + " ", "fr", "src1", 9), (10_003, "", "en", "src2", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).cache()
    rows = docs.collect()
    model = li.fit_documents(docs, corpus_pipeline.TOKENIZER)
    pred = {r.doc_id: r for r in li.predict(docs, model).collect()}
    want = brute(rows, lambda d: pred[d.doc_id].lang_pred != "und" and pred[d.doc_id].score >= 0.3)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.collect(), docs.schema)
    got = sorted(now.collect(), key=lambda d: d.doc_id)
    assert [tuple(d) for d in got] == [tuple(d) for d in want]
    assert not {10_000, 10_001, 10_003} & {d.doc_id for d in got}
    mixed = corpus_pipeline.STAGES[3][1](spark, now, SF)
    assert mixed.columns == docs.columns
    mixed = mixed.collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, taken, used = Counter(), Counter(), Counter(d.doc_id for d in mixed)
    for d in got:
        size[d.source] += words(d.text)
        taken[d.source] += used[d.doc_id] * words(d.text)
    assert max(used.values()) <= 2 and set(used) <= {d.doc_id for d in got}
    longest = max(words(d.text) for d in got)
    assert all(abs(taken[s] - t) <= longest for s, t in water_fill(size).items())
    out = corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame(mixed, docs.schema), SF).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {d.doc_id: d.text for d in mixed}
    assert Counter(r.doc_id for r in out) == used
    for r in out:
        assert list(r.ids) == library.encode(text[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(list(r.ids)).encode()).hexdigest()


def test_run_and_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 100
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_repeated_and_null_rows_do_not_crash(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = [(None, None, None, None, None), (None, "x y z", None, None, None), (1, "same", "en", "s", 4), (1, "same", "en", "s", 4), (1, "other", "en", "s", 4)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "1 as copies", "'a' as h", "2L as node", "'b' as digest")
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert out.count() > 0 and (k == 4 or out.columns == docs.columns)

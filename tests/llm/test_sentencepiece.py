import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from newsloom.llm.sentencepiece_codec import Codec, encode_documents, load
from tests.conftest import SF

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  a", "a  ", "\n", "\t\ta b", "▁", "▁▁ x", " ▁x", "<s> </s> <unk> <0x41>", "龘 🏎️ é e\u0301", "a\u0000b", "aaaaaaaaaaaaaaaaaaaaaa",
    "ab" * 500, "    " * 50, "x" + " " * 33 + "y", "1234567890", "İstanbul ǅ ß", "\ufffd\u200b", "the " * 30, "𝔘𝔫𝔦", "ererererer onononon", "........" * 9,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(texts, library):
    model = load(PATH)
    codec = Codec(model)
    for t in texts:
        want = library.encode(t)
        assert model.encode(t) == want, t[:200]
        assert model.decode(want) == library.decode(want), t[:200]
        codec.look_up(set(model.split(t)))
        assert codec.encoded(t) == (len(want), ",".join(map(str, want)), library.decode(want))


def test_odd_texts(library):
    check(ODD, library)


def test_random_texts(library):
    rng = random.Random(5)
    alphabets = ["ab ", "eratinos ", "aàéñ ▁\n", "0123456789.,- ", "the ing er on "] + ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(60))]
    check(["".join(rng.choices(a, k=rng.randrange(1, 300))) for a in alphabets for _ in range(60)], library)


def test_long_word_without_spaces(library):
    rng = random.Random(6)
    check(["".join(rng.choices("eratinos", k=20_000)), "na" * 10_000], library)


def test_unknown_ids_decode_as_the_library_does(library):
    model = load(PATH)
    for ids in ([], [0], [1, 2], [1, 278], [0, 278, 0], [259, 259], [231, 150, 160], [150, 278], [278, 231, 278], [3 + 0xF0, 3 + 0x9F, 278]):
        assert model.decode(ids) == library.decode(ids), ids


def test_documents_nulls_and_extra_columns(spark, library):
    df = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "n_chars n_tokens", "lang ids_sha256")
    df = df.unionByName(spark.createDataFrame([(None, None, 0, ""), (-1, None, 0, ""), (-2, "", 0, "")], df.schema))
    got = sorted((tuple(r) for r in encode_documents(df, PATH).collect()), key=repr)
    want = []
    for r in df.collect():
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert encode_documents(df.limit(0), PATH).count() == 0
    full = encode_documents(df, PATH, with_ids=True, with_text=True).where("doc_id = 3").first()
    assert library.decode(list(full.ids)) == full.decoded

"""Language identification by segmentation-marginalised unigrams (operator 9).

Each language has a probability for every piece of a fixed public vocabulary
(and for single characters outside it). The probability of a word is the sum over
all ways to cut it into pieces of the product of their probabilities, which a
forward algorithm computes; a text's score is the sum of its words' logarithms.
Piece probabilities are learned by expectation maximisation with the matching
forward-backward counts.

Training reads a bounded sample, in one pass over the texts: per language at most ``sample_docs`` labelled
rows, those with the smallest hash of their id, and of each the first
``sample_chars`` characters; only this sample's word counts reach the driver. There runs of
more than LONGEST letters are counted in stretches.
Prediction reads every text whole. Words are lower-cased runs of letters; each
distinct word is scored once per task in a bounded cache, many words at a time:
step j of the recursion handles position j of all words and one piece length. Longer runs,
as scripts without spaces have, are not kept: they are scored in windows that carry
the forward values of the last positions and a scale, so that every segmentation of the whole run counts.

The prediction never sees lang, source or doc_id. ``score`` is the share of the
best language in the posterior over all languages when the log likelihood is
taken per word (per LONGEST letters of a longer run) and tempered by ``sharpness``; it lies between 0 and 1.

Edges: a null text, or one without letters, is ``und`` with score 0. Ties go to
the language that sorts first. Texts in no learned language still get the nearest
one, with a score near 1 / languages. Rows with null lang or id are not learned
from but predicted; a table without labelled rows predicts ``und`` throughout. Repeated rows are
predicted alike; an empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import common, sentencepiece_codec

LETTERS = regex.compile(r"\p{L}+")
UND = "und"
#: Of the table of known words: bytes, and what a word takes besides its numbers.
CACHE_BYTES, WORD_BYTES = 32_000_000, 150
#: Longer words are scored in windows of WINDOW letters.
LONGEST, WINDOW = 40, 32


def vocabulary(path: str) -> list[str]:
    """The letter pieces of the public vocabulary, lower case, with ^ for a word's start."""
    model = sentencepiece_codec.load(path)
    found = set()
    for piece, kind in zip(model.pieces, model.kinds, strict=True):
        body = piece.lower().lstrip(sentencepiece_codec.MARK)
        if kind == sentencepiece_codec.NORMAL and body and LETTERS.fullmatch(body):
            found.add(("^" if piece.startswith(sentencepiece_codec.MARK) else "") + body)
    return sorted(found)


class Pieces:
    """Looks up pieces by a rolling hash of their characters."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], order.astype(np.int64)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a hash")
        self.lengths = sorted({len(p) for p in pieces})

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.BASE) + ord(c) + 1) % 2**64
        return h

    def lattice(self, words: list[str]) -> tuple[np.ndarray, dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]]:
        """Sizes of the marked words, and per (end, length) the words and piece ids of an arc.

        A single character without a piece has the id len(pieces).
        """
        sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
        width = int(sizes.max())
        grid = np.zeros((len(words), width), np.uint64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        grid[np.arange(width)[None, :] < sizes[:, None]] = flat
        prefix = np.zeros((len(words), width + 1), np.uint64)
        for j in range(width):
            prefix[:, j + 1] = prefix[:, j] * self.BASE + grid[:, j] + np.uint64(1)
        power = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for _ in range(self.longest):
                power.append(power[-1] * self.BASE)
        arcs = {}
        for end in range(1, width + 1):
            alive = np.flatnonzero(sizes >= end)
            for n in self.lengths:
                if n > end:
                    break
                key = prefix[alive, end] - prefix[alive, end - n] * power[n]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                if n == 1:  # every character can stand alone
                    arcs[end, n] = alive, np.where(hit, self.ids[at], len(self.pieces))
                elif hit.any():
                    arcs[end, n] = alive[hit], self.ids[at[hit]]
        return sizes, arcs


def forward(sizes: np.ndarray, arcs: dict, prob: np.ndarray) -> np.ndarray:
    """alpha[word, position, language]: the mass of all segmentations of each prefix."""
    alpha = np.zeros((len(sizes), int(sizes.max()) + 1, prob.shape[1]))
    alpha[:, 0] = 1.0
    for (end, n), (rows, ids) in arcs.items():  # in order of end
        alpha[rows, end] += alpha[rows, end - n] * prob[ids]
    return alpha


def expected_counts(words: list[str], weights: np.ndarray, pieces: Pieces, prob: np.ndarray) -> tuple[np.ndarray, float]:
    """Expected uses of each piece over all segmentations, and the log likelihood, by language."""
    counts, total = np.zeros_like(prob), 0.0
    step = 4000
    for at in range(0, len(words), step):
        sizes, arcs = pieces.lattice(words[at : at + step])
        w = weights[at : at + step]
        alpha = forward(sizes, arcs, prob)
        beta = np.zeros_like(alpha)
        beta[np.arange(len(sizes)), sizes] = 1.0
        whole = np.maximum(alpha[np.arange(len(sizes)), sizes], 1e-300)
        for (end, n), (rows, ids) in reversed(arcs.items()):
            beta[rows, end - n] += beta[rows, end] * prob[ids]
        for (end, n), (rows, ids) in arcs.items():
            mass = alpha[rows, end - n] * prob[ids] * beta[rows, end] / whole[rows] * w[rows]
            np.add.at(counts, ids, mass)
        total += float((np.log(whole) * w).sum())
    return counts, total


def words_of(text: str | None) -> list[str]:
    """Marked lower-case words of a text."""
    return ["^" + w for w in LETTERS.findall((text or "").lower())]


def stretches(words: list[str]) -> list[str]:
    """The words, long ones cut."""
    return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]


class Model:
    """Languages with their piece probabilities."""

    def __init__(self, languages: list[str], pieces: Pieces, prob: np.ndarray, sharpness: float):
        self.languages, self.pieces, self.prob, self.sharpness = languages, pieces, prob, sharpness

    @classmethod
    def fit(cls, counts: dict[str, Counter], pieces: list[str], rounds: int = 4, sharpness: float = 1.0) -> Model:
        """Learn from word counts by language; expectation maximisation from a flat start."""
        look = Pieces(pieces)
        languages = sorted(counts)
        words = sorted({w for c in counts.values() for w in c})
        weights = np.array([[counts[lang][w] for lang in languages] for w in words], float).reshape(len(words), len(languages))
        lengths = np.array([len(p) for p in pieces] + [1])
        prob = np.repeat((0.05 ** lengths)[:, None], len(languages), axis=1)
        prob /= prob.sum(axis=0)
        for _ in range(rounds if words else 0):
            found, _ = expected_counts(words, weights, look, prob)
            found += 0.02  # no piece is impossible in a language
            prob = found / found.sum(axis=0)
        return cls(languages, look, prob, sharpness)

    def log_probs(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, by slices of like size."""
        out = np.empty((len(words), len(self.languages)))
        order = np.argsort([len(w) for w in words], kind="stable")
        step = 4000
        for at in range(0, len(words), step):
            some = order[at : at + step]
            sizes, arcs = self.pieces.lattice([words[i] for i in some])
            alpha = forward(sizes, arcs, self.prob)
            out[some] = np.log(np.maximum(alpha[np.arange(len(sizes)), sizes], 1e-300))
        return out

    def long_log_probs(self, words: list[str]) -> np.ndarray:
        """Log probability of each word of any length, by windows that all words go through together."""
        keep = self.pieces.longest
        out = np.zeros((len(words), len(self.languages)))
        tail = np.zeros((len(words), keep, len(self.languages)))  # forward values of the last positions, over their largest
        tail[:, -1] = 1.0
        scale = np.zeros_like(out)
        alive = np.arange(len(words))
        at = 0
        while len(alive):
            before = min(at, keep - 1)  # letters that a piece may reach back over
            sizes, arcs = self.pieces.lattice([words[i][at - before : at + WINDOW] for i in alive])
            alpha = np.zeros((len(alive), int(sizes.max()) + 1, len(self.languages)))
            alpha[:, : before + 1] = tail[alive, keep - 1 - before :]
            for (end, n), (rows, ids) in arcs.items():
                if end > before:
                    alpha[rows, end] += alpha[rows, end - n] * self.prob[ids]
            ends = np.array([len(words[i]) <= at + WINDOW for i in alive])
            done = np.flatnonzero(ends)
            out[alive[done]] = np.log(np.maximum(alpha[done, sizes[done]], 1e-300)) + scale[alive[done]]
            alive, alpha = alive[~ends], alpha[~ends]
            last = alpha[:, -keep:]
            most = np.maximum(last.max(axis=1), 1e-300)
            tail[alive, keep - last.shape[1] :] = last / most[:, None]
            tail[alive, : keep - last.shape[1]] = 0.0
            scale[alive] += np.log(most)
            at += WINDOW
        return out

    def decide(self, total: np.ndarray, n_words: int) -> tuple[str, float]:
        """The best language of summed log probabilities and its share of the posterior."""
        if not n_words or not self.languages:
            return UND, 0.0
        mean = total / n_words * self.sharpness
        share = np.exp(mean - mean.max())
        best = int(np.argmax(total))
        return self.languages[best], float(share[best] / share.sum())


def held_out_flag(id_col: Column) -> Column:
    """Rows of the fold that is never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_counts(train: DataFrame, sample_docs: int, sample_chars: int) -> dict[str, Counter]:
    """Word counts of at most ``sample_docs`` rows per language of (doc_id, text, lang), of ``sample_chars`` characters each."""
    # few labels: the set of languages, not of rows; texts are not read for this
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # a hash bound leaves about twice the rows wanted, the smallest of which are taken
    bounds = [(lang, int(min(1.0, 2.0 * sample_docs / n + 50 / n) * 2**31)) for lang, n in sizes.items()]
    table = train.sparkSession.createDataFrame(bounds, "lang string, bound long")
    rank = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(2**31))
    near = train.join(F.broadcast(table), "lang").withColumn("rank", rank).where("rank <= bound and text is not null")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "doc_id", F.md5("text")))
    sample = near.withColumn("place", place).where(F.col("place") <= sample_docs).select("lang", F.substring("text", 1, sample_chars).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.update((lang, w) for w in stretches(words_of(text)))
        if found:
            columns = [[k[0] for k in found], [k[1] for k in found], [*found.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])

    out = {lang: Counter() for lang in sorted(sizes)}
    # the words of a bounded sample
    for r in sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        out[r["lang"]][r["word"]] = r["n"]
    return out


def fit_documents(
    docs: DataFrame, vocabulary_path: str, sample_docs: int = 250, sample_chars: int = 8_000, sharpness: float = 1.0
) -> Model:
    """Learn from the labelled rows of (doc_id, text, lang) outside the held-out fold."""
    train = docs.where(~held_out_flag(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    return Model.fit(sample_counts(train.select("doc_id", "text", "lang"), sample_docs, sample_chars), vocabulary(vocabulary_path), sharpness=sharpness)


class Scorer:
    """Scores texts with a bounded table of words."""

    def __init__(self, languages: list[str], pieces: list[str], prob: np.ndarray, sharpness: float):
        self.model = Model(languages, Pieces(pieces), prob, sharpness)
        self.place: dict[str, int] = {}
        self.table = np.empty((CACHE_BYTES // (WORD_BYTES + 8 * len(languages)), len(languages)))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        cut = [words_of(t) for t in texts]
        short = [[w for w in t if len(w) <= LONGEST] for t in cut]
        missing = list({w for t in short for w in t if w not in self.place})
        if len(self.place) + len(missing) > len(self.table):
            self.place.clear()
            missing = list({w for t in short for w in t})
            if len(missing) > len(self.table):
                self.table = np.empty((len(missing), self.table.shape[1]))
        if missing:
            begin = len(self.place)
            self.table[begin : begin + len(missing)] = self.model.log_probs(missing)
            self.place.update(zip(missing, range(begin, begin + len(missing)), strict=True))
        total = np.array([self.table[[self.place[w] for w in t]].sum(axis=0) for t in short]).reshape(len(texts), self.table.shape[1])
        counts = np.array([len(t) for t in short], np.int64)
        longer = [(k, w) for k, t in enumerate(cut) for w in t if len(w) > LONGEST]
        if longer and self.model.languages:
            at = np.array([k for k, _ in longer])
            np.add.at(total, at, self.model.long_log_probs([w for _, w in longer]))
        for k, w in longer:
            counts[k] += -(-len(w) // LONGEST)
        return [self.model.decide(t, n) for t, n in zip(total, counts.tolist(), strict=True)]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces.pieces, model.prob, model.sharpness))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(*shipped.value)
        for whole in batches:
            for batch in common.slices(whole, "text", 2 << 20):
                found = score(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out_flag(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_languages(docs: DataFrame, model: Model, languages: list[str] | None = None, min_score: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs in one of the languages (all learned ones by default) with at least ``min_score``."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces.pieces, model.prob, model.sharpness))
    wanted = set(languages or model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(*shipped.value)
        for whole in batches:
            for batch in common.slices(whole, text_col, 2 << 20):
                keep = [lang in wanted and share >= min_score for lang, share in score(batch.column(text_col).to_pylist())]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, fit_documents(docs, public_tokenizers.path("piece_bpe_32k.model")))

"""SentencePiece encoding and decoding by vectorised merge rounds (operator 5).

A model file of the BPE kind is read without the library: its protocol-buffer
records give the pieces, their scores and kinds, and the normaliser's switches.
Encoding works on many words at once. All symbols of all words lie in one flat
numpy array. A round finds each word's smallest pair rank, merges every
occurrence of that pair from the left, and compacts the array; words without a
ranked pair leave. Merging one pair can make a pair of a smaller rank; such a
round stops in that word after the merge that made it, so that the order is the
library's own, one merge at a time by rank and then from the left.

Words are the stretches that start at a run of word marks. They are encoded
apart only when no piece has a mark after another character, so that no merge can
cross their border; a model without that property is encoded text by text.
Each distinct word of a task is encoded once, in a bounded cache.

Edges: null is the empty text, which has no ids; texts of any length are
encoded whole; control characters, marks in the input and characters outside the
vocabulary follow the library (byte pieces, or the unknown id without them). An
empty table gives an empty result. Columns besides the id and text are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import common

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words that a task remembers: about so many bytes with what Python adds to each, and words no longer than so many characters.
CACHE_BYTES, WORD_BYTES, CACHED_WORD = 24_000_000, 200, 64
#: Characters that are encoded together at most, unless one word alone is longer.
CHUNK_CHARS = 120_000


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (buf[at] & 0x7F) << shift
            shift += 7
            at += 1
            if buf[at - 1] < 0x80:
                return value, at

    at = 0
    while at < len(buf):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = buf[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = buf[at : at + size], at + size
        yield key >> 3, value


class Model:
    """Pieces of a SentencePiece BPE model and the pair table for merge rounds."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.add_prefix, self.trim, self.escape = True, True, True
        model_type, byte_fallback, charsmap, self.unk_surface = 1, 0, b"", " ⁇ "
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.kinds.append(kind)
                scores.append(score)
            elif number == 2:
                for n, v in _fields(value):
                    model_type = v if n == 3 else model_type
                    byte_fallback = v if n == 35 else byte_fallback
                    self.unk_surface = v.decode() if n == 44 else self.unk_surface
            elif number == 3:
                for n, v in _fields(value):
                    charsmap = v if n == 2 else charsmap
                    self.add_prefix = bool(v) if n == 3 else self.add_prefix
                    self.trim = bool(v) if n == 4 else self.trim
                    self.escape = bool(v) if n == 5 else self.escape
        if model_type != 2 or charsmap or self.trim or not self.escape or USER_DEFINED in self.kinds or UNUSED in self.kinds:
            raise ValueError("only BPE models with identity normalisation and plain pieces are supported")
        self.unknown = self.kinds.index(UNKNOWN)
        ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE} if byte_fallback else {}
        # single characters that have no piece of their own may still be part of one
        size = len(self.pieces)
        symbols = dict(ids)
        for c in sorted({c for p in ids for c in p} - ids.keys()):
            symbols[c] = size
            size += 1
        self.other = size  # any character that no piece has
        self.width = size + 1
        self.char_ids = {c: i for c, i in symbols.items() if len(c) == 1}
        points = np.array([ord(c) for c in self.char_ids], np.int64)
        self.char_table = np.full(0x110000, self.other, np.int32)
        self.char_table[points] = np.fromiter(self.char_ids.values(), np.int32, len(points))
        # equal scores merge from the left whatever their piece, so they share a rank
        order = np.unique(-np.array(scores, np.float64), return_inverse=True)[1]
        keys, ranks, merged = [], [], []
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                a, b = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    ranks.append(order[i])
                    merged.append(i)
        by_key = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.array(keys, np.int64)[by_key]
        self.pair_ranks = np.array(ranks, np.int64)[by_key]
        self.pair_ids = np.array(merged, np.int64)[by_key]
        self.words_apart = not any(MARK in p.lstrip(MARK) for p in ids)
        self.none = np.int64(1 << 40)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece id of each pair of symbols; the rank is ``none`` where no piece joins them."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], self.none), np.where(hit, self.pair_ids[at], -1)

    def encode_words(self, words: list[str]) -> tuple[list[int], list[int]]:
        """All ids one after another, and where each word's ids begin and end; by merge rounds."""
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.char_table[flat].astype(np.int64)
        strange = symbol == self.other
        symbol[strange] = -1 - flat[strange]  # keeps the character
        word = np.repeat(np.arange(len(words)), sizes)
        rank, piece = self._pairs(symbol, word, np.arange(len(symbol)))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        low = np.full(len(words), self.none)
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low[word[starts]] = np.minimum.reduceat(rank, starts)
            mine = low[word]
            done = mine == self.none
            if done.any():  # words leave whole, so that what stays keeps its neighbours
                out.append((word[done], symbol[done]))
                symbol, word, rank, piece, mine = (x[~done] for x in (symbol, word, rank, piece, mine))
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == mine)
            # of a run of overlapping occurrences every second one merges
            run = np.r_[True, np.diff(at) != 1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            at, made = self._until_lower(at, piece[at], symbol, word, low)
            symbol[at] = made
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            now = at - np.arange(len(at))  # each merge moves what follows by one
            symbol, word, rank, piece = symbol[stay], word[stay], rank[stay], piece[stay]
            changed = np.r_[now, now[now > 0] - 1]
            rank[changed], piece[changed] = self._pairs(symbol, word, changed)
        which = np.concatenate([w for w, _ in out]) if out else np.empty(0, np.int64)
        ids = np.concatenate([s for _, s in out]) if out else np.empty(0, np.int64)
        order = np.argsort(which, kind="stable")
        ids, which = ids[order], which[order]
        odd = (ids < 0) | (ids >= len(self.pieces))
        if odd.any():  # characters without a piece are spelled in bytes
            spelled = {s: self._spelled(s) for s in np.unique(ids[odd]).tolist()}
            size = np.ones(len(ids), np.int64)
            size[odd] = [len(spelled[s]) for s in ids[odd].tolist()]
            which = np.repeat(which, size)
            long = np.repeat(odd, size)
            filled = np.repeat(ids, size)
            filled[long] = [x for s in ids[odd].tolist() for x in spelled[s]]
            ids = filled
        return ids.tolist(), np.searchsorted(which, np.arange(len(words) + 1)).tolist()

    def _pairs(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pairs that begin at some places; none at a word's end."""
        after = np.minimum(at + 1, max(len(symbol) - 1, 0))
        left, right = symbol[at], symbol[after]
        inside = (at < after) & (word[at] == word[after]) & (left >= 0) & (right >= 0)
        rank, piece = np.full(len(at), self.none), np.full(len(at), -1, np.int64)
        rank[inside], piece[inside] = self.ranks(left[inside], right[inside])
        return rank, piece

    def _until_lower(
        self, at: np.ndarray, made: np.ndarray, symbol: np.ndarray, word: np.ndarray, low: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Cut a round, in each word, after the first merge that makes a pair of no larger rank."""
        last = len(symbol) - 1
        prior = np.r_[False, at[1:] == at[:-1] + 2]
        left = np.where(prior, np.r_[0, made[:-1]], symbol[np.maximum(at - 1, 0)])
        left_rank = np.full(len(at), self.none)
        ok = (at > 0) & (word[np.maximum(at - 1, 0)] == word[at]) & (left >= 0)
        left_rank[ok] = self.ranks(left[ok], made[ok])[0]
        after = np.minimum(at + 2, last)
        right = symbol[after]
        right_rank = np.full(len(at), self.none)
        ok = (at + 2 <= last) & (word[after] == word[at]) & (right >= 0)
        right_rank[ok] = self.ranks(made[ok], right[ok])[0]
        lower = np.minimum(left_rank, right_rank) <= low[word[at]]
        if not lower.any():
            return at, made
        stop = np.full(len(low), last + 1)
        np.minimum.at(stop, word[at[lower]], at[lower])
        keep = at <= stop[word[at]]
        return at[keep], made[keep]

    def _spelled(self, symbol: int) -> tuple[int, ...]:
        """Ids for a character without a piece: its bytes, or the unknown id."""
        char = chr(-1 - symbol) if symbol < 0 else next(c for c, i in self.char_ids.items() if i == symbol)
        return tuple(self.bytes[b] for b in char.encode("utf-8", "surrogatepass")) if self.bytes else (self.unknown,)

    def split(self, text: str) -> list[str]:
        """The text as the model sees it, cut where no merge can cross."""
        if not text:
            return []
        seen = (MARK if self.add_prefix else "") + text.replace(" ", MARK)
        return WORDS.findall(seen) if self.words_apart else [seen]

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text."""
        return self.encode_words(self.split(text))[0] if text else []

    def decode(self, ids) -> str:
        """The text of ids: byte pieces joined and read as UTF-8, marks back to spaces."""
        out, raw, begun = [], bytearray(), False
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                raw.append(int(self.pieces[i][3:5], 16))
                begun = True
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            if kind == CONTROL:
                continue
            piece = self.unk_surface if kind == UNKNOWN else self.pieces[i]
            if not begun and self.add_prefix and kind == NORMAL and piece.startswith(MARK):
                piece = piece[1:]
            begun = True
            out.append(piece if kind == UNKNOWN else piece.replace(MARK, " "))
        if raw:
            out.append(_utf8(raw))
        return "".join(out)


def _utf8(raw: bytearray) -> str:
    """Bytes as text; each byte that starts no whole character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        first = raw[at]
        size = 1 if first < 0x80 else 2 if 0xC2 <= first < 0xE0 else 3 if 0xE0 <= first < 0xF0 else 4 if 0xF0 <= first < 0xF5 else 0
        try:
            out.append(bytes(raw[at : at + size]).decode() if size else "�")
            at += size or 1
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    """The model at a path of this machine, read once per process."""
    with open(path, "rb") as f:
        return Model(f.read())


class Codec:
    """Texts to ids and back with a cache of words that is bounded by bytes; long words are kept for one batch."""

    def __init__(self, model: Model):
        self.model = model
        # a word's ids, joined by commas; where they do not read as the word itself, with what they read as
        self.cache: dict[str, str | tuple[str, str]] = {}
        self.passing: dict[str, str | tuple[str, str]] = {}
        self.held = 0
        self.names = [str(i) for i in range(len(model.pieces))]
        self.plain = frozenset(i for i, k in enumerate(model.kinds) if k == NORMAL)

    def look_up(self, words: set[str]) -> None:
        """Encode the words that the cache lacks, in chunks of bounded size."""
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        self.passing = {}
        missing = [w for w in words if w not in self.cache]
        at = 0
        while at < len(missing):
            end, chars = at, 0
            while end < len(missing) and (end == at or chars + len(missing[end]) <= CHUNK_CHARS):
                chars += len(missing[end])
                end += 1
            chunk = missing[at:end]
            ids, bounds = self.model.encode_words(chunk)
            names, plain = self.names, self.plain
            for k, w in enumerate(chunk):
                own = ids[bounds[k] : bounds[k + 1]]
                found = ",".join([names[i] for i in own])
                if not plain.issuperset(own):  # bytes to gather
                    found = (found, self.surface(own))
                if len(w) <= CACHED_WORD:
                    self.cache[w] = found
                    self.held += WORD_BYTES + len(w) + len(found)
                else:
                    self.passing[w] = found
            at = end

    def surface(self, ids: list[int]) -> str:
        """The text of one word's ids with all its spaces."""
        m = self.model
        return m.decode([self.anchor, *ids])[1:] if m.add_prefix else m.decode(ids)

    @property
    def anchor(self) -> int:
        """Any one-character piece; put before a word it keeps that word's first mark."""
        return self.model.char_ids["a"]

    def encoded(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and the decoded text; the words must be cached."""
        cache, passing = self.cache, self.passing
        words = self.model.split(text)
        found = [cache.get(w) or passing[w] for w in words]
        if tuple in set(map(type, found)):
            decoded = "".join([w.replace(MARK, " ") if isinstance(f, str) else f[1] for w, f in zip(words, found, strict=True)])
            ids = ",".join([f if isinstance(f, str) else f[0] for f in found])
        else:
            decoded, ids = "".join(words).replace(MARK, " "), ",".join(found)
        if self.model.add_prefix and decoded.startswith(" "):
            decoded = decoded[1:]
        return ids.count(",") + 1 if ids else 0, ids, decoded


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with_ids adds the ids, with_text the decoded text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(load(model_path))
        for whole in batches:
            for batch in common.slices(whole, "text", 1 << 20):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                codec.look_up({w for t in texts for w in codec.model.split(t)})
                rows = [codec.encoded(t) for t in texts]
                columns = [
                    batch.column("doc_id"),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([sha(r[1]) for r in rows], pa.string()),
                    pa.array([sha(r[2]) for r in rows], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.cumsum([0, *(r[0] for r in rows)], dtype=np.int32)
                    flat = np.fromstring(",".join([r[1] for r in rows if r[1]]), np.int32, sep=",")
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())))
                    names.append("ids")
                if with_text:
                    columns.append(pa.array([r[2] for r in rows], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents under the public 32k vocabulary."""
    return encode_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

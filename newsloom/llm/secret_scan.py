"""Secret scan by a linear-chain conditional random field (operator 13).

Fixed rules find secrets of known form (``base_spans``). A conditional random field then tags every
token of the text as the beginning of a secret, its inside, or outside, and adds what the rules miss.

*Tokens* are runs of letters, digits and ``+ / _ -``. *Features* of a token, each hashed to
a row of one weight table: its length, kinds of characters and changes between them (shape), whether it could be
hexadecimal, the word itself if it holds no digit, the words before and after it and their last letters, what
stands between them, and three of the file: shares of digits, of punctuation and of lines. They are computed
with numpy over the code points of many texts at once.

*Decoding* is Viterbi's. A token whose score as outside exceeds the others by more than any two transitions can
make up is outside on every best path, so the chain falls apart there; only the stretches between such tokens
are decoded, all of them step by step together. This is exact. A text longer than ``PIECE`` is read in pieces that end at
such a token, so memory does not grow with it.

*Fitting.* The field is trained on the driver (stochastic gradient of its likelihood) on windows of ``WINDOW`` code points
of at most ``SAMPLE`` documents with a rule's match and as many without one, the least by hash, labelled by the
rules; into copies of them, secrets of other forms and things that only look like one are written in. All texts are scanned.

Edges: a null text counts as empty, has no spans and the digest of no bytes. Spans are in code points, end
exclusive. Spans of the field that touch a rule's span are left out; a rule's span always stays. Equal texts get
equal spans. Without any document with a match the field learns from what is written into the others; an
empty table gives an empty result. Repeated rows and null ids are rows like others; further columns are ignored.
"""

from __future__ import annotations

import heapq
import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import common

# Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
LEAST_VALUE, LEAST_ACCESS = 6, 20

#: Documents of the training sample with a match, and without.
SAMPLE = 1_000
#: Code points of a window of the sample.
WINDOW = 400
#: Code points of a long text that are in memory at once.
PIECE = 1 << 20
BUCKETS = 1 << 16
OUT, BEGIN, IN = range(3)
SEP, LOWER, UPPER, DIGIT, MARK, OTHER = range(6)

CLASSES = np.zeros(129, np.uint8)
for _chars, _kind in ((string.ascii_lowercase, LOWER), (string.ascii_uppercase, UPPER), (string.digits, DIGIT), ("+/_-", MARK)):
    CLASSES[[ord(c) for c in _chars]] = _kind
CLASSES[128] = OTHER
HEXADECIMAL = np.zeros(129, bool)
HEXADECIMAL[[ord(c) for c in string.hexdigits]] = True

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the rules' matches, sorted."""
    out = []
    lower = text.lower()  # may be longer or shorter than the text: only to see whether a word can occur
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]  # runs are as long as they can be, so shorter ones need no dropping
    return sorted(out)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


class Powers:
    """Powers of an odd number modulo 2**64, and of its inverse."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.BASE, -k, 1 << 64))])


POWERS = Powers()


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mixed(kind: int, *values: np.ndarray) -> np.ndarray:
    """Rows of the weight table for values of one kind of feature."""
    x = np.uint64(kind * 0x2545F4914F6CDD1D & (1 << 64) - 1)
    for v in values:
        x = (x ^ v.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(29))
    return (x >> np.uint64(48)).astype(np.uint16)


LENGTHS = np.array([2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 44, 64], np.int64)


def file_features(counts: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Three small numbers for each text from its counts of the six character classes (separators included) and its line ends."""
    n = np.maximum(counts.sum(1), 1)
    level = lambda part, steps: np.searchsorted(np.array(steps), part / n, "right")
    return np.stack([level(counts[:, DIGIT], (0.01, 0.05, 0.2)), level(counts[:, SEP] + counts[:, MARK], (0.15, 0.22, 0.35)), level(lines, (0.002, 0.01, 0.03))], 1)


@dataclass
class Tokens:
    """Tokens of texts laid one after the other: where they start and end, their text, and their feature rows."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    features: np.ndarray


def class_counts(codes: np.ndarray) -> np.ndarray:
    """Of one text: the six character classes, then line ends."""
    return np.append(np.bincount(CLASSES[np.minimum(codes, 128)], minlength=6), np.count_nonzero(codes == 10))


def tokens_of(texts: list[np.ndarray], counts: np.ndarray) -> Tokens:
    """Tokens and features of texts given as code points; ``counts`` are class_counts of the whole texts they belong to."""
    gap = np.array([10], np.uint32)
    codes = np.concatenate([x for t in texts for x in (t, gap)])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    low = np.minimum(codes, 128)
    kinds = CLASSES[low]
    edges = np.flatnonzero(np.diff((kinds > 0).astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    text = np.searchsorted(bounds, starts, "right")
    n = ends - starts

    def total(flags: np.ndarray) -> np.ndarray:
        run = np.cumsum(flags, dtype=np.int32)
        return run[ends - 1] - np.where(starts > 0, run[starts - 1], 0)

    count = {k: total(kinds == k) for k in (LOWER, UPPER, DIGIT, MARK)}
    count[OTHER] = n - sum(count.values())
    changed = np.zeros(len(codes), bool)
    changed[1:] = kinds[1:] != kinds[:-1]
    changes = np.minimum(total(changed) - 1, 7)
    hexadecimal = total(HEXADECIMAL[low]) == n
    POWERS.grow(len(codes) + 1)
    folded = codes + np.where(kinds == UPPER, np.uint32(32), np.uint32(0))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((folded + np.uint32(1)).astype(np.uint64) * POWERS.up[: len(codes)], dtype=np.uint64)])
    hashed = lambda a, b: (sums[b] - sums[a]) * POWERS.down[a]

    length = np.searchsorted(LENGTHS, n, "right")
    mask = sum((count[k] > 0).astype(np.int64) << (k - 1) for k in (LOWER, UPPER, DIGIT, MARK, OTHER))
    shape = (length * 32 + mask) * 8 + changes
    share = lambda k: count[k] * 5 // np.maximum(n, 1)
    plain = (count[DIGIT] == 0) & (n <= 16)
    word = np.where(plain, hashed(starts, ends), shape.astype(np.uint64))
    tail = np.where(plain, hashed(np.maximum(ends - 3, starts), ends), np.uint64(1))
    between = np.empty(len(starts) + 1, np.uint64)  # before each token, and after the last
    between[0] = between[-1] = 2
    between[1:-1] = np.where(starts[1:] - ends[:-1] <= 4, hashed(ends[:-1], starts[1:]), np.uint64(3))
    same = text[1:] == text[:-1]
    between[1:-1][~same] = 2

    def moved(values: np.ndarray, by: int) -> np.ndarray:
        """The value ``by`` tokens on in the same text, else 0."""
        out = np.zeros(len(values), np.uint64)
        k = abs(by)
        if len(values) > k:
            inside = text[k:] == text[:-k]
            if by < 0:
                out[k:] = np.where(inside, values[:-k], np.uint64(0))
            else:
                out[:-k] = np.where(inside, values[k:], np.uint64(0))
        return out

    before, cue = moved(word, -1), moved(tail, -1)
    long = (n >= 8).astype(np.int64) + (n >= 20) + 4 * (count[DIGIT] > 0) + 8 * (count[UPPER] > 0) * (count[LOWER] > 0)
    file = file_features(counts[:, :6], counts[:, 6])[text]
    rows = [
        _mixed(1, np.zeros(len(n))), _mixed(2, shape), _mixed(3, length, share(DIGIT), share(UPPER)), _mixed(4, hexadecimal, length, count[DIGIT] > 0),
        _mixed(5, word), _mixed(6, before), _mixed(7, moved(word, -2)), _mixed(8, moved(word, 1)), _mixed(9, between[:-1]), _mixed(10, between[1:]),
        _mixed(11, cue, between[:-1], long), _mixed(12, moved(tail, -2), long), _mixed(13, length, changes),
        *(_mixed(14 + k, file[:, k]) for k in range(3)),
    ]
    return Tokens(starts, ends, text, np.stack(rows, 1) if len(n) else np.empty((0, 16), np.uint16))


@dataclass
class Field:
    """Weights of feature rows (BUCKETS x 3) and of transitions (from, to); a chain begins and ends outside."""

    weights: np.ndarray
    moves: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3), np.float32)
        for k in range(features.shape[1]):
            out += self.weights[features[:, k]]
        return out

    def margins(self) -> np.ndarray:
        """By how much transitions can prefer each label to outside, whatever stands around."""
        t = self.moves
        gain = lambda y: (t[:, y] - t[:, OUT]).max() + (t[y, :] - t[OUT, :]).max()
        return np.array([gain(BEGIN), gain(IN)], np.float32)

    def certain(self, scores: np.ndarray) -> np.ndarray:
        """Tokens that every best path has outside."""
        over = scores[:, OUT : OUT + 1] - scores[:, 1:]
        return (over > self.margins() + 1e-3).all(1)


def viterbi(scores: np.ndarray, first: np.ndarray, size: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Labels of all stretches (first token, number of tokens), decoded together; other tokens are outside."""
    labels = np.zeros(len(scores), np.int8)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    if not len(first):
        return labels
    back = np.zeros((len(scores), 3), np.int8)
    best = moves[OUT] + scores[first]
    longest = int(size[0])
    alive = np.searchsorted(-size, -np.arange(longest + 1), "left")  # stretches with more than t tokens
    for t in range(1, longest):
        k = alive[t]
        ways = best[:k, :, None] + moves[None]
        back[first[:k] + t] = ways.argmax(1)
        best[:k] = ways.max(1) + scores[first[:k] + t]
    now = (best + moves[:, OUT]).argmax(1).astype(np.int8)
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        labels[first[:k] + t] = now[:k]
        if t:
            now[:k] = back[first[:k] + t, now[:k]]
    return labels


def decoded(scores: np.ndarray, text: np.ndarray, sure: np.ndarray, field: Field) -> np.ndarray:
    """Labels of the best path of each text: stretches between tokens that are surely outside."""
    open_ = ~sure
    begins = open_.copy()
    begins[1:] &= sure[:-1] | (text[1:] != text[:-1])
    first = np.flatnonzero(begins)
    ends = open_.copy()
    ends[:-1] &= sure[1:] | (text[1:] != text[:-1])
    return viterbi(scores, first, np.flatnonzero(ends) - first + 1, field.moves)


def _spans(tokens: Tokens, labels: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, start, end) of the tagged secrets, in the code points of their texts."""
    hits = np.flatnonzero(labels)
    now = None
    for i in hits.tolist():
        t, a, b = int(tokens.text[i]), int(tokens.starts[i]), int(tokens.ends[i])
        if now and labels[i] == IN and now[3] == i - 1 and now[0] == t:
            now = (t, now[1], b, i)
            continue
        if now:
            yield now[0], now[1] - int(offsets[now[0]]), now[2] - int(offsets[now[0]])
        now = (t, a, b, i)
    if now:
        yield now[0], now[1] - int(offsets[now[0]]), now[2] - int(offsets[now[0]])


def field_spans(texts: list[str], field: Field, piece: int = PIECE) -> list[list[tuple[int, int]]]:
    """The secrets that the field sees in each text."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    short = [i for i, t in enumerate(texts) if 0 < len(t) <= piece]
    if short:
        codes = [codes_of(texts[i]) for i in short]
        tokens = tokens_of(codes, np.stack([class_counts(c) for c in codes]))
        scores = field.scores(tokens.features)
        offsets = np.cumsum([0, *(len(c) + 1 for c in codes)])
        for k, a, b in _spans(tokens, decoded(scores, tokens.text, field.certain(scores), field), offsets):
            out[short[k]].append((a, b))
    for i, t in enumerate(texts):
        if len(t) > piece:
            out[i] = long_spans(t, field, piece)
    return out


#: Tokens that a piece repeats of the one before it, so that all features see their words.
CONTEXT = 4


def long_spans(text: str, field: Field, piece: int) -> list[tuple[int, int]]:
    """The same for one long text, in pieces that end at tokens surely outside."""
    counts = sum(class_counts(codes_of(text[a : a + piece])) for a in range(0, len(text), piece))[None]
    out, at, size, skip = [], 0, piece, 0
    while True:
        end = min(at + size, len(text))
        tokens = tokens_of([codes_of(text[at:end])], counts)
        scores = field.scores(tokens.features)
        sure = field.certain(scores)
        sure[:skip] = True  # decoded by the piece before
        stop = len(sure)
        if end < len(text):
            # the last token that is surely outside with its context in view; the piece may end inside of a token
            cuts = np.flatnonzero(sure[: max(stop - CONTEXT, 0)])
            cuts = cuts[cuts > 2 * CONTEXT + skip]
            if not len(cuts):
                if not len(sure):
                    at, size, skip = end, piece, 0  # only separators
                else:
                    size *= 2
                continue
            stop = int(cuts[-1]) + 1
        labels = decoded(scores[:stop], tokens.text[:stop], sure[:stop], field)
        out += [(a + at, b + at) for _, a, b in _spans(tokens, labels, np.zeros(1, np.int64))]
        if end == len(text):
            return out
        at, size, skip = at + int(tokens.starts[stop - CONTEXT]), piece, CONTEXT


# Fitting


def weak_labels(text: str, tokens: Tokens, marked: list[tuple[int, int]], at: int) -> np.ndarray:
    """Labels of one text's tokens (which begin at ``at``) by the values of the rules' matches and marked spans."""
    values = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    values += [(a, b) for a, k, b in base_spans(text) if k] + marked
    labels = np.zeros(len(tokens.starts), np.int8)
    for a, b in sorted(values):
        inside = np.flatnonzero((tokens.starts >= a + at) & (tokens.ends <= b + at))
        if len(inside) and not labels[inside].any():
            labels[inside] = IN
            labels[inside[0]] = BEGIN
    return labels


CUES = (
    "password", "passwd", "pwd", "pass", "passphrase", "secret", "client_secret", "CLIENT_SECRET", "token", "access_token", "auth_token", "API_TOKEN", "api_key",
    "apiKey", "API key", "private_key", "secret_key", "SECRET_ACCESS_KEY", "access key", "credential", "Authorization: Bearer", "bearer",
)
LINKS = ("=", ": ", " = ", ":", " ", ' = "', '": "', "='", " is ")
ALNUM = string.ascii_letters + string.digits


def invented_secret(rng: random.Random) -> str:
    """A random string of one of the forms that secrets have."""
    some = lambda chars, low, high: "".join(rng.choices(chars, k=rng.randint(low, high)))
    form = rng.randrange(7)
    if form == 0:
        return some("0123456789abcdef", 16, 64)
    if form == 1:
        return some("0123456789ABCDEF", 24, 64)
    if form == 2:
        return some(ALNUM, 20, 48)
    if form == 3:
        return some(ALNUM + "+/", 30, 60) + rng.choice(("", "=", "=="))
    if form == 4:
        return some(string.ascii_lowercase, 2, 4) + rng.choice("_-") + some(ALNUM, 20, 40)
    if form == 5:
        return ".".join(some(ALNUM + "_-", 20, 40) for _ in range(3))
    return some(string.ascii_uppercase, 4, 4) + some(string.ascii_uppercase + string.digits, 16, 16)


def invented_lookalike(rng: random.Random) -> str:
    """A random string that holds no secret though it is long, mixed, or stands after a cue."""
    some = lambda chars, low, high: "".join(rng.choices(chars, k=rng.randint(low, high)))
    word = lambda: some(string.ascii_lowercase, 2, 12)
    form = rng.randrange(10)
    if form == 0:
        return f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}:{rng.randint(0, 59):02}"
    if form == 1:
        return "https://" + ".".join(word() for _ in range(2)) + ".com/" + "/".join(word() + some(string.digits, 0, 3) for _ in range(rng.randint(1, 4)))
    if form == 2:
        return f"{word()}.{rng.randint(1, 999)}@{word()}.org"
    if form == 3:
        return word().capitalize() + word().capitalize() + rng.choice(("", word().capitalize(), some(string.digits, 1, 2)))
    if form == 4:
        return "_".join(word() for _ in range(rng.randint(2, 4)))
    if form == 5:
        return some(string.digits, 3, 16)
    if form == 6:
        return "-".join(some("0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12))
    if form == 7:
        return rng.choice(CUES) + rng.choice((" ", " of ", ": ", " is ")) + word()
    if form == 8:
        return some(string.ascii_lowercase, 14, 40)
    return f"+{rng.randint(1, 99)} {some(string.digits, 3, 3)} {some(string.digits, 3, 4)}-{some(string.digits, 4, 4)}"


def invented_windows(window: str, rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A window with a few secrets and lookalikes written in between its words, and where the secrets stand."""
    words = re.split(r"(\s+)", window)
    out, marked = "", []
    spots = set(rng.sample(range(len(words)), min(len(words), 4)))
    for k, w in enumerate(words):
        if k in spots:
            if rng.random() < 0.5:
                out += rng.choice((" ", "\n", ' "')) + rng.choice(CUES) + rng.choice(LINKS)
                secret = invented_secret(rng)
                marked.append((len(out), len(out) + len(secret)))
                out += secret + rng.choice((" ", "\n", '" ', "' ", ", "))
            else:
                out += " " + invented_lookalike(rng) + rng.choice((" ", ". ", "\n", ", "))
        out += w
    return out, marked


def train(windows: list[str], seed: int = 13, rounds: int = 12, batches: int = 8, rate: float = 0.35, decay: float = 2e-6) -> Field:
    """A field fitted to windows and to copies of them with secrets written in, by adaptive gradient steps."""
    rng = random.Random(seed)
    cases: list[tuple[str, list[tuple[int, int]]]] = []
    for w in windows:
        cases += [(w, []), invented_windows(w, rng)]
    weights, moves = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
    if not cases:
        return Field(weights.astype(np.float32), moves.astype(np.float32))
    codes = [codes_of(t) for t, _ in cases]
    tokens = tokens_of(codes, np.stack([class_counts(c) for c in codes]))
    offsets = np.cumsum([0, *(len(c) + 1 for c in codes)])
    cut = np.searchsorted(tokens.text, np.arange(len(cases) + 1))
    features, labels = tokens.features.astype(np.int64), np.zeros(len(tokens.text), np.int64)
    for k, (text, marked) in enumerate(cases):
        part = Tokens(*(a[cut[k] : cut[k + 1]] for a in (tokens.starts, tokens.ends, tokens.text, tokens.features)))
        labels[cut[k] : cut[k + 1]] = weak_labels(text, part, marked, int(offsets[k]))
    size = np.diff(cut)
    sizes_w, sizes_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    shuffled = [k for k in range(len(cases)) if size[k]]
    for _ in range(rounds):
        rng.shuffle(shuffled)
        for b in range(batches):
            mine = np.array(shuffled[b::batches], np.int64)
            if not len(mine):
                continue
            mine = mine[np.argsort(-size[mine], kind="stable")]
            where, grad, grad_m = _gradient(weights, moves, features, labels, cut[mine], size[mine])
            wide = features[where]
            step = np.stack([np.bincount(wide.ravel(), np.repeat(grad[:, y], wide.shape[1]), BUCKETS) for y in range(3)], 1) / len(mine) + decay * weights
            sizes_w += step * step
            weights -= rate * step / np.sqrt(sizes_w)
            step_m = grad_m / len(mine) + decay * moves
            sizes_m = 0.9 * sizes_m + step_m * step_m  # few, and far from their place at first
            moves -= rate * step_m / np.sqrt(sizes_m)
    return Field(weights.astype(np.float32), moves.astype(np.float32))


def _gradient(weights: np.ndarray, moves: np.ndarray, features: np.ndarray, labels: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple:
    """Tokens, and the gradients of the negative log-likelihood by their scores and by the transitions, by forward and backward sums."""
    longest = int(size[0])
    alive = np.searchsorted(-size, -np.arange(longest + 1), "left")
    grid = first[:, None] + np.minimum(np.arange(longest), size[:, None] - 1)
    scores = weights[features[grid]].sum(2)  # chains x steps x labels
    lse = lambda x, axis: (top := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis))
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = moves[OUT] + scores[:, 0]
    for t in range(1, longest):
        k = alive[t]
        ahead[:k, t] = lse(ahead[:k, t - 1, :, None] + moves, 1) + scores[:k, t]
    every = np.arange(len(first))
    behind[every, size - 1] = moves[:, OUT]
    grad_m = np.zeros((3, 3))
    whole = lse(ahead[every, size - 1] + moves[:, OUT], 1)
    for t in range(longest - 2, -1, -1):
        k = alive[t + 1]
        after = scores[:k, t + 1] + behind[:k, t + 1]
        behind[:k, t] = lse(moves + after[:, None, :], 2)
        pairs = np.exp(ahead[:k, t, :, None] + moves + after[:, None, :] - whole[:k, None, None])
        grad_m += pairs.sum(0)
        np.add.at(grad_m, (labels[grid[:k, t]], labels[grid[:k, t + 1]]), -1)
    share = np.exp(ahead + behind - whole[:, None, None])
    grad_m[OUT] += share[:, 0].sum(0)
    grad_m[:, OUT] += share[every, size - 1].sum(0)
    np.add.at(grad_m, (OUT, labels[grid[:, 0]]), -1)
    np.add.at(grad_m, (labels[grid[every, size - 1]], OUT), -1)
    inside = np.arange(longest) < size[:, None]
    where, grad = grid[inside], share[inside]
    grad[np.arange(len(where)), labels[where]] -= 1
    return where, grad, grad_m


def _sampled(sample: int, window: int):
    """Of each task, the windows of the documents least by hash: some with a rule's match, some without."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[list, list] = ([], [])
        for whole in batches:
            for batch in common.slices(whole, "text"):
                for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    spans = base_spans(text)
                    best = kept[bool(spans)]
                    if len(best) == sample and -h <= best[0][0]:
                        continue
                    at = max(0, spans[0][0] - window // 3) if spans else h % max(1, len(text) - window)
                    (heapq.heappush if len(best) < sample else heapq.heapreplace)(best, (-h, text[at : at + window]))
        rows = [(hit, -h, w) for hit, best in enumerate(kept) for h, w in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.string()))], ["hit", "h", "window"])

    return windows


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, window: int = WINDOW) -> Field:
    """The field, trained on windows of at most 2 * sample documents."""
    rows = docs.where(F.length(text_col) > 0).select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    found = common.stored(rows.mapInArrow(_sampled(sample, window), "hit int, h long, window string"), "windows")
    windows = [r["window"] for hit in (1, 0) for r in found.where(F.col("hit") == hit).orderBy("h", "window").limit(sample).collect()]
    return train(list(dict.fromkeys(windows)))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_crf", pa.int64())])
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"


def apart(found: list[tuple[int, int]], base: list[Span]) -> list[Span]:
    """The field's spans that touch no rule's span (``base`` is sorted)."""
    starts = [a for a, _, _ in base]
    reach = [0, *accumulate((b for _, _, b in base), max)]  # the furthest end of the first k
    return [(a, 3, b) for a, b in found if reach[bisect_left(starts, b)] <= a]


def scan_texts(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text the rules' spans, and all spans."""
    out = []
    for text, found in zip(texts, field_spans(texts, field), strict=True):
        base = base_spans(text)
        out.append((base, sorted(base + apart(found, base))))
    return out


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every text, and counts and digest of the rules' ones; see the module."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", 2 << 20):
                made = []
                for i, (base, spans) in zip(batch.column("doc_id").to_pylist(), scan_texts(batch.column("text").to_pylist(), field), strict=True):
                    n = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                    made.append((i, *n[:3], sha256(written(base).encode()).hexdigest(), written(spans), n[3]))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], f.type) for k, f in enumerate(SCHEMA)], schema=SCHEMA)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(rows, RESULT)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, by the rules and by a field trained on a sample of them."""
    docs = common.table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))

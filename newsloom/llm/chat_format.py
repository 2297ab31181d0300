"""Chat formatting with minimum-cost role repair (operator 10).

A conversation must follow a legal-turn automaton: an optional system turn,
then user and assistant in turn, ending with the assistant. Dynamic programming
over the automaton's states picks the cheapest repair of the roles as they come:

* keep a turn (free), or merge it into the turn before if that has its role;
* relabel it, or relabel and merge it;
* insert empty turns before it, or at the end.

Of equally cheap repairs of a conversation, the one whose state after the last
turn is earliest in ROLES wins, then the one whose state before that is, and so
on to the first turn; a step between two states takes the action listed first
above. The repair is so defined by the conversation alone. Roles are compared
trimmed and in lower case; a null or unknown role has to be relabelled. The
repaired turns are rendered with start and end tags; tags inside a text are
broken by a space.

A conversation may hold any share of all rows, so no task gathers one. Turns are
sorted by range into segments, as many as keep a segment near ``segment_rows``
turns and ``segment_bytes`` bytes. What a segment does to a conversation that
crosses its borders is a 4 x 4 matrix of least costs between states, and for each
end state the order in which the tie rule prefers the start states. Both are
chained turn by turn and reach the driver once per border; the driver chains
them over the segments of each conversation, forward for costs and backward for
the choice, and fixes the state at each border. Every segment then repairs its
turns between fixed states, which gives the same repair wherever the cuts are. A
task holds the turns of one conversation in one segment as Arrow buffers, and a
byte of role and four of back pointers a turn beside them.

Result: a row per turn with its piece of the rendered text and its position (0, 1,
... in its conversation); the pieces of a conversation in order are the rendered
conversation.

Edges: turns are ordered by turn (null first), then role, then text; repeated rows stay.
All rows with null conv_id are one conversation. A null text is empty. An empty
table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import common

ROLES = ("", "system", "user", "assistant")
#: State: role of the last turn, 0 before the first. Legal successors of each.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
FINAL = 3
MERGE, INSERT, RELABEL = 1, 2, 3
NONE = 10**9
START, END = "<|im_start|>", "<|im_end|>"
SCHEMA = (
    "conv_id long, turn long, role string, action string, new_role string, inserted_before int, inserted_after int, cost int, "
    "position long, rendered string"
)
STATES = range(4)


@lru_cache(maxsize=None)
def path(a: int, b: int) -> tuple[int, ...] | None:
    """Shortest legal run of turns from state a that ends in state b; empty if a is b."""
    ways = [(a, ())]
    seen = {a}
    for state, run in ways:
        if state == b:
            return run
        for s in NEXT[state]:
            if s not in seen:
                seen.add(s)
                ways.append((s, (*run, s)))
    return None


@lru_cache(maxsize=None)
def step(role: int, a: int, b: int) -> tuple[int, str, tuple[int, ...]]:
    """Least cost to take a turn of a role (0: unknown) from state a to b, its action, and the turns inserted before."""
    found = [(NONE, 9, "", ())]
    for p in STATES:
        between = path(a, p)
        if between is not None and b in NEXT[p]:
            same = ROLES[b] == ROLES[role]
            cost = INSERT * len(between) + (0 if same else RELABEL)
            found.append((cost, 2 if between else 0 if same else 3, "keep" if same else "relabel", between))
    if a == b and a:
        same = a == role
        found.append((MERGE + (0 if same else RELABEL), 1 if same else 4, "merge" if same else "relabel and merge", ()))
    cost, _, action, between = min(found)
    return cost, action, between


@lru_cache(maxsize=None)
def finish(a: int) -> tuple[int, tuple[int, ...]]:
    """Cost and turns to insert at the end of a conversation in state a."""
    run = path(a, FINAL)
    return INSERT * len(run), run


Chain = tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, ...], ...]]
#: A segment without turns: costs[a][b], and places[b][a] of the start states a in the tie rule's order for the end state b.
IDENTITY: Chain = (tuple(tuple(0 if a == b else NONE for b in STATES) for a in STATES), tuple(tuple(STATES) for _ in STATES))


@lru_cache(maxsize=200_000)
def chain(so_far: Chain, role: int) -> Chain:
    """A segment after one more turn; costs are relative to the least, so that few different chains occur."""
    costs, places = so_far
    ways = [[min((costs[a][s] + step(role, s, b)[0], s) for s in STATES) for b in STATES] for a in STATES]
    low = min(w[0] for row in ways for w in row)
    new_costs = tuple(tuple(min(w[0] - low, NONE) if w[0] < NONE else NONE for w in row) for row in ways)
    new_places = []
    for b in STATES:
        # the path whose state before b is earlier comes first, then the one that comes first there
        order = sorted(STATES, key=lambda a: (ways[a][b][1], places[ways[a][b][1]][a]))
        new_places.append(tuple(order.index(a) for a in STATES))
    return new_costs, tuple(new_places)


@lru_cache(maxsize=200_000)
def _forward(cost: tuple[int, ...], role: int) -> tuple[tuple[int, ...], bytes]:
    """Relative costs of the states after a turn, and the state before each on the cheapest way."""
    ways = [min((cost[s] + step(role, s, b)[0], s) for s in STATES) for b in STATES]
    low = min(w[0] for w in ways)
    return tuple(w[0] - low if w[0] < NONE else NONE for w in ways), bytes(w[1] for w in ways)


def _last(cost: tuple[int, ...] | list[int]) -> int:
    return min(STATES, key=lambda s: (cost[s] + finish(s)[0], s))


def repair(roles: bytes | tuple[int, ...], start: int = 0, end: int | None = None) -> list[int]:
    """The state after each turn, on the cheapest way from start to end (None: any, then finished)."""
    cost = tuple(0 if s == start else NONE for s in STATES)
    back = bytearray()
    for role in roles:
        cost, ways = _forward(cost, role)
        back += ways
    state = end if end is not None else _last(cost)
    out = []
    for k in range(len(roles) - 1, -1, -1):
        out.append(state)
        state = back[4 * k + state]
    return out[::-1]


@lru_cache(maxsize=100_000)
def _repair_short(roles: bytes, start: int, end: int | None) -> list[int]:
    """repair() for the short role sequences that come again and again."""
    return repair(roles, start, end)


def role_of(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else 0


def clean(text: str | None) -> str:
    return (text or "").replace(START, "<| im_start|>").replace(END, "<| im_end|>")


def _row(conv, turn, role, text, a: int, b: int, last: bool, position: int) -> tuple:
    """A result row: the turn that goes from state a to b, and the end of the conversation if it is the last."""
    cost, action, between = step(role_of(role), a, b)
    piece = "\n\n" + clean(text) if action.endswith("merge") else (END + "\n" if a else "") + "".join(
        f"{START}{ROLES[s]}\n{END}\n" for s in between
    ) + f"{START}{ROLES[b]}\n{clean(text)}"
    after: tuple[int, ...] = ()
    if last:
        more, after = finish(b)
        cost += more
        piece += END + "\n" + "".join(f"{START}{ROLES[s]}\n{END}\n" for s in after)
    return conv, turn, role, action, ROLES[b], len(between), len(after), cost, position, piece


def _segment_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each segment and conversation at its border: the first and the last of the segment."""

    def out(segment: int, conv: int | None, place: int, turns: int, so_far: Chain) -> pa.RecordBatch:
        costs, places = ([x for row in m for x in row] for m in so_far)
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        columns = [[x] for x in (segment, conv, place, turns, costs, places)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], BORDER_NAMES)

    segment, conv, place, turns, now = None, None, 0, 0, IDENTITY
    for batch in batches:
        for s, c, role in zip(*(batch.column(n).to_pylist() for n in ("segment", "conv_id", "role")), strict=True):
            if not turns or s != segment or c != conv:
                if turns and (place == 0 or s != segment):
                    yield out(segment, conv, place, turns, now)
                place = 0 if not turns or s != segment else 1
                segment, conv, turns, now = s, c, 0, IDENTITY
            now = chain(now, role_of(role))
            turns += 1
    if turns:
        yield out(segment, conv, place, turns, now)


BORDER_NAMES = ["segment", "conv_id", "place", "turns", "costs", "places"]
BORDER = "segment int, conv_id long, place int, turns long, costs array<long>, places array<long>"


def border_states(found: list[tuple[int, int | None, int, int, list[int], list[int]]]) -> dict[int, tuple[int, int, bool, int | None]]:
    """What a segment has to know of its neighbours, for segments that a conversation runs into or out of.

    By segment: state in which its first conversation begins and its turns before, whether the last
    one ends there, and in which state it goes on. ``found`` has the rows of _segment_chains.
    """
    found = sorted(found, key=lambda r: (r[0], r[2]))
    out: dict[int, list] = {}
    at = 0
    while at < len(found):
        end = at  # a stretch of segments that one conversation runs through
        while end + 1 < len(found) and found[end + 1][1] == found[at][1] and found[end + 1][0] != found[end][0]:
            end += 1
        if end > at:
            entry = [[0, NONE, NONE, NONE]]
            for *_, costs, _ in found[at : end + 1]:
                entry.append([min(entry[-1][a] + costs[4 * a + b] for a in STATES) for b in STATES])
                low = min(entry[-1])
                entry[-1] = [min(x - low, NONE) for x in entry[-1]]
            state = _last(entry[-1])
            turns = sum(r[3] for r in found[at : end + 1])
            for k in range(end, at, -1):
                segment, _, _, n, costs, places = found[k]
                state = min(STATES, key=lambda a: (entry[k - at][a] + costs[4 * a + state], places[4 * state + a]))
                turns -= n
                out.setdefault(segment, [0, 0, True, None])[:2] = [state, turns]
                out.setdefault(found[k - 1][0], [0, 0, True, None])[2:] = [False, state]
        at = end + 1
    return {k: tuple(v) for k, v in out.items()}


class _Writer:
    """Repairs and renders the turns of a task, one conversation in one segment after the other."""

    KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
    NAMES = [f.split()[0] for f in SCHEMA.split(", ")]

    def __init__(self, borders: dict[int, tuple[int, int, bool, int | None]]):
        self.borders, self.rows, self.size, self.before = borders, [], 0, None

    def full(self, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows, strict=True), self.KINDS, strict=True)], self.NAMES)
            self.rows, self.size = [], 0

    def run(self, parts: list[pa.RecordBatch], last_of_segment: bool) -> Iterator[pa.RecordBatch]:
        """``parts`` are the turns of one conversation in one segment."""
        segment = parts[0].column("segment")[0].as_py()
        start, position, ends, goes_on = self.borders.get(segment, (0, 0, True, None))
        if segment == self.before:  # not the first of its segment
            start = position = 0
        if not last_of_segment:
            ends, goes_on = True, None
        self.before = segment
        roles = bytes(role_of(r) for p in parts for r in p.column("role").to_pylist())
        states = (_repair_short if len(roles) <= 16 else repair)(roles, start, None if ends else goes_on)
        a, at = start, 0
        for p in parts:
            for conv, turn, role, text in zip(*(p.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                b = states[at]
                at += 1
                self.rows.append(_row(conv, turn, role, text, a, b, ends and at == len(states), position))
                self.size += len(text or "") + 64
                position += 1
                a = b
            yield from self.full()


def _render(batches: Iterator[pa.RecordBatch], writer: _Writer) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    key = None
    for whole in batches:
        for batch in common.slices(whole, "text"):
            keys = list(zip(batch.column("segment").to_pylist(), batch.column("conv_id").to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if held and keys[begin] != key:
                    yield from writer.run(held, key[0] != keys[begin][0])
                    held = []
                key = keys[begin]
                held.append(batch.slice(begin, end - begin))
    if held:
        yield from writer.run(held, True)
    yield from writer.full(0)


def format_conversations(turns: DataFrame, segments: int | None = None, segment_rows: int = 100_000, segment_bytes: int = 32 << 20) -> DataFrame:
    """A row per turn of (conv_id, turn, role, text): its repair and its piece of the rendered conversation."""
    spark = turns.sparkSession
    own = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", F.xxhash64("text").alias("h"))
    n = segments
    if n is None:
        size = own.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["rows"] // segment_rows), -(-(size["bytes"] or 0) // segment_bytes))
    order = ["conv_id", "turn", "role", "h"]
    # rows alike in all four are interchangeable; the last key spreads them over segments
    placed = common.stored(
        own.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *order, "tie")
        .sortWithinPartitions(*order, "text", "tie")
        .drop("tie", "h")
        .withColumn("segment", F.spark_partition_id())
        .withColumn("spot", F.monotonically_increasing_id()),
        "turns",
    )

    def dealt(*columns: str) -> DataFrame:
        return placed.select("segment", "spot", *columns).repartitionByRange(n, "segment").sortWithinPartitions("segment", "spot")

    borders = dealt("conv_id", "role").mapInArrow(_segment_chains, BORDER)
    states = border_states([tuple(r) for r in borders.collect()])  # two rows a segment at most
    shipped = spark.sparkContext.broadcast(states)
    return dealt("conv_id", "turn", "role", "text").mapInArrow(lambda batches: _render(batches, _Writer(shipped.value)), SCHEMA)


def assemble(pieces: DataFrame) -> DataFrame:
    """conv_id and the whole rendered text, for conversations that fit into one row."""
    parts = F.array_sort(F.collect_list(F.struct("position", "rendered")))
    return pieces.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["rendered"]), "").alias("rendered"), F.sum("cost").alias("cost"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired and rendered turns of all conversations."""
    return format_conversations(common.table(spark, sf_dir, "conversations"))

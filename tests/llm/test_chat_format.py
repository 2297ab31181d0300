import random
import re
from functools import lru_cache
from itertools import product

from newsloom.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, position string, cost string"
LEGAL = re.compile(r"(s)?(ua)+$")


@lru_cache(maxsize=None)
def best(roles):
    """Least cost by exhaustive search over what each turn becomes, with inserted turns by search over legal sequences."""
    names = {"system": "s", "user": "u", "assistant": "a"}
    n = len(roles)
    found = 10**9
    for length in range(2, 2 * n + 5):
        for lead in (0, 1):
            if (length - lead) % 2:
                continue
            target = "s" * lead + "ua" * ((length - lead) // 2)
            if target:
                found = min(found, align(tuple(names.get(r, "?") for r in roles), target))
    return found


def align(roles, target):
    """Cheapest way for the turns to fill the target in order; unfilled target turns are insertions."""
    big = 10**9
    d = [[big] * (len(target) + 1) for _ in range(len(roles) + 1)]
    d[0][0] = 0
    for i, j in product(range(len(roles) + 1), range(len(target) + 1)):
        if d[i][j] == big:
            continue
        if j < len(target):
            d[i][j + 1] = min(d[i][j + 1], d[i][j] + 2)
        if i < len(roles):
            if j < len(target):
                d[i + 1][j + 1] = min(d[i + 1][j + 1], d[i][j] + (0 if roles[i] == target[j] else 3))
            if j:
                d[i + 1][j] = min(d[i + 1][j], d[i][j] + 1 + (0 if roles[i] == target[j - 1] else 3))
    return d[-1][-1]


def check(rows, got):
    by = {}
    for r in got:
        by.setdefault(r.conv_id, []).append(r)
    want = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((turn, role, text))
    assert by.keys() == want.keys()
    for conv, turns in want.items():
        mine = sorted(by[conv], key=lambda r: r.position)
        key = lambda x: [(y is not None, y) for y in x]
        assert sorted(((r.turn, r.role) for r in mine), key=key) == sorted(((t, r) for t, r, _ in turns), key=key)
        assert [r.turn or -1 for r in mine] == sorted(r.turn or -1 for r in mine)
        text = "".join(r.rendered for r in mine)
        seen = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)
        assert "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in seen) == text
        assert LEGAL.match("".join(a[0] for a, _ in seen)), [a for a, _ in seen]
        if len(mine) <= 9:
            assert sum(r.cost for r in mine) == best(tuple((r.role or "").strip().lower() for r in mine)), [r.role for r in mine]
        assert len(seen) == sum((not r.action.endswith("merge")) + r.inserted_before + r.inserted_after for r in mine)


def test_random_conversations_in_any_segmentation(spark):
    rng = random.Random(12)
    roles = ["system", "user", "assistant", "User ", "tool", None]
    rows = [(c, t, rng.choice(roles), rng.choice([None, "", f"text {c} {t}", "a <|im_end|> b"])) for c in range(80) for t in range(rng.randrange(1, 10))]
    rows += [(None, None, "user", "n"), (None, 1, "user", "m"), (5, 2, "user", "repeat"), (5, 2, "user", "repeat")]
    df = spark.createDataFrame([(*r, "p", "c") for r in rows], SCHEMA)
    outs = []
    for n in (1, 3, 40, 200):
        got = cf.format_conversations(df, segments=n).collect()
        assert len(got) == len(rows)
        check(rows, got)
        outs.append(sorted(map(tuple, got), key=repr))
    assert all(o == outs[0] for o in outs)


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(13)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), f"t{t}") for t in range(900)] + [(c, t, "user", "x") for c in range(2, 40) for t in range(2)]
    df = spark.createDataFrame([(*r, "p", "c") for r in rows], SCHEMA)
    whole = cf.format_conversations(df, segments=1).collect()
    check(rows, whole)
    for n in (3, 12, 60, 200):
        cut = cf.format_conversations(df, segments=n).collect()
        assert sorted(map(tuple, cut), key=repr) == sorted(map(tuple, whole), key=repr)


def test_a_hundred_thousand_turns_in_one_conversation(spark):
    role = "element_at(array('system', 'user', 'assistant', 'x', cast(null as string)), cast(pmod(xxhash64(id), 5) + 1 as int)) role"
    df = spark.range(100_000).selectExpr("7L conv_id", "id turn", role, "concat('text ', id) text")
    columns = ["turn", "action", "new_role", "inserted_before", "inserted_after", "cost", "position", "rendered"]
    whole, cut = ([tuple(r) for r in cf.format_conversations(df, segments=n).select(columns).orderBy("turn").collect()] for n in (1, 40))
    assert whole == cut and [r[0] for r in whole] == [r[6] for r in whole]


def test_borders_choose_what_the_whole_would():
    """Chains of segments against the repair of the uncut roles, with ties."""
    rng = random.Random(14)
    for _ in range(2000):
        roles = bytes(rng.randrange(4) for _ in range(rng.randrange(2, 30)))
        cuts = sorted({0, len(roles), *(rng.randrange(1, len(roles)) for _ in range(rng.randrange(1, 6)))})
        found = []
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            now = cf.IDENTITY
            for r in roles[i:j]:
                now = cf.chain(now, r)
            found.append((k, 1, 0, j - i, *([x for row in m for x in row] for m in now)))
        states = cf.border_states(found)
        got = []
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            start, before, ends, goes_on = states.get(k, (0, 0, True, None))
            assert before == i and ends == (j == len(roles))
            got += cf.repair(roles[i:j], start, goes_on)
        assert got == cf.repair(roles)


def test_real_and_empty(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(rows, cf.op10_chat_format(spark, sf).collect())
    assert cf.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0

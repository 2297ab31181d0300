"""The automaton finds what trying the grammar at every word finds."""

import random
import re

from newsloom.operators import entities as e


class Everywhere(e.Lexicon):
    """A lexicon that tries every word of a text."""

    def starts(self, text):
        return [m.start() for m in re.finditer(r"\b(?=\w)", text)]


def texts(n, seed):
    rng = random.Random(seed)
    lex = e.Lexicon()
    words = [*lex.brands, *lex.aliases, *lex.cased_brands, *lex.series, *(c.upper() for c in lex.capitals), *lex.connectors[:6]]
    words += ["GT-R", "R34", "Supra", "2020", "Mk4", "foo", "affords", "landrover", "niſſan", "İ", "-", "\n", "  ", ".", "K-POP", "911", "z", "é"]
    spelled = (str, str.title, str.upper, str.lower)
    for _ in range(n):
        yield "".join(rng.choice(spelled)(rng.choice(words)) + rng.choice((" ", " ", "  ", "-", "", "\n")) for _ in range(rng.randrange(14)))


def test_automaton_agrees_with_every_word():
    fast, slow = e.Lexicon(), Everywhere()
    named = 0
    for t in texts(4000, 3):
        got = fast.scan(t)
        assert got == slow.scan(t), t
        named += bool(got["strict"]) + bool(got["pairs"])
    assert named > 2000


def test_letters_whose_lower_case_differs_are_tried_everywhere():
    lex = e.Lexicon()
    for t in ("İstanbul: Nissan Z32", "Niſſan Z32", "Mını Cooper"):
        assert lex.scan(t) == Everywhere().scan(t)
        assert lex.scan(t)["strict"]


def test_empty_lexicon_and_texts():
    bare = e.Lexicon(brands=(), aliases={}, cased_brands=(), series={}, capitals=(), recurring=())
    assert bare.scan("Ford Mustang") == {"strict": [], "brands": [], "series": [], "pairs": []}
    assert e.Lexicon().scan(None) == bare.scan("") == bare.scan("x")


def test_time_does_not_depend_on_the_number_of_names():
    many = e.Lexicon(brands=(*e.Lexicon().brands, *(f"name{i} word" for i in range(20_000))))
    assert many.scan("a name77 word X5 and a Ford Focus")["strict"] == ["ford focus", "name77 word x5"]


def test_column_function(spark):
    df = spark.createDataFrame([(1, "Chevy Camaro at SDCC"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.fp for r in df.select("id", e.fingerprint()("text").alias("fp")).collect()}
    assert got[1].strict == ["chevrolet camaro at"] or got[1].strict == ["chevrolet camaro"]
    assert got[1].series == ["san diego comic-con"] and got[2].strict == got[3].strict == []

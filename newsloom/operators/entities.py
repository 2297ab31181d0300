"""Entity fingerprints: brand and model phrases, series names and their pair keys.

One pass of an Aho-Corasick automaton over the lower-case text finds where a brand, an
alias or a series may begin (the first words of all names are its keys). Only there are the
rules of the grammar tried, so the time of a text is that of the automaton plus its hits, whatever
the number of names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

FINGERPRINT = "struct<strict:array<string>,brands:array<string>,series:array<string>,pairs:array<string>>"


@dataclass(frozen=True)
class Lexicon:
    """Names to look for; the defaults are the fixed values of the domain."""

    brands: tuple[str, ...] = (
        "acura", "aston martin", "audi", "bugatti", "buick", "cadillac", "chevrolet", "chrysler", "datsun", "dodge", "ferrari", "ford",
        "honda", "hudson", "jeep", "koenigsegg", "lamborghini", "land rover", "lexus", "mazda", "mclaren", "mercedes", "mini",
        "mitsubishi", "nissan", "pagani", "plymouth", "pontiac", "porsche", "range rover", "subaru", "toyota", "volkswagen",
    )
    aliases: dict[str, str] = field(default_factory=lambda: {"chevy": "chevrolet", "vw": "volkswagen", "mercedes-benz": "mercedes"})
    #: Recognised in exactly this case, and never with a model.
    cased_brands: tuple[str, ...] = ("AMC", "BMW", "Lotus")
    #: Alias to (name, tier); only the tier distinctive can block.
    series: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "k-pop demon hunters": ("k-pop demon hunters", "distinctive"),
            "kpop demon hunters": ("k-pop demon hunters", "distinctive"),
            "stranger things": ("stranger things", "distinctive"),
            "top gun": ("top gun", "distinctive"),
            "san diego comic-con": ("san diego comic-con", "distinctive"),
            "comic-con": ("san diego comic-con", "distinctive"),
            "sdcc": ("san diego comic-con", "distinctive"),
            "red line club": ("red line club", "broad"),
            "rlc": ("red line club", "broad"),
            "super treasure hunt": ("super treasure hunt", "broad"),
            "sth": ("super treasure hunt", "broad"),
            "car culture": ("car culture", "broad"),
            "boulevard": ("boulevard", "broad"),
            "team transport": ("team transport", "broad"),
            "zamac": ("zamac", "broad"),
            "pop culture": ("pop culture", "broad"),
            "monster trucks": ("monster trucks", "broad"),
        }
    )
    #: Aliases that only count in capitals.
    capitals: tuple[str, ...] = ("sdcc", "rlc", "sth")
    #: Programmes that run all the time: never a key without a model.
    recurring: tuple[str, ...] = ("super treasure hunt", "red line club")
    connectors: tuple[str, ...] = (
        "de", "do", "da", "dos", "das", "e", "em", "no", "na", "nos", "nas", "com", "para", "por", "ao", "aos", "of", "the", "a", "an",
        "and", "for", "with", "in", "on", "at", "to", "from", "by", "or", "vs",
    )

    def problems(self) -> list[str]:
        """What is wrong with the lexicon; empty if it can be used."""
        out = []
        tiers: dict[str, set[str]] = {}
        for alias, (name, tier) in self.series.items():
            if "|" in name or "\n" in name:
                out.append(f"series {name!r} holds a separator")
            if alias != alias.lower():
                out.append(f"alias {alias!r} is not lower case")
            tiers.setdefault(name, set()).add(tier)
        out += [f"series {n!r} has tiers {sorted(ts)}" for n, ts in tiers.items() if len(ts) > 1]
        out += [f"recurring {n!r} is not a broad series" for n in self.recurring if tiers.get(n) != {"broad"}]
        return out

    @cached_property
    def _all_brands(self) -> frozenset[str]:
        return frozenset(self.brands) | frozenset(b.lower() for b in self.cased_brands) | frozenset(self.aliases)

    @cached_property
    def _brand_at(self) -> re.Pattern:
        """A brand at a position; no boundary is asked for after it."""
        names = sorted({*self.brands, *self.aliases}, key=lambda n: (" " not in n, -len(n), n))
        spelled = "|".join(r"\s{1,2}".join(map(re.escape, n.split(" "))) for n in names) or r"(?!)"
        return re.compile(rf"\b(?:{spelled})", re.I)

    @cached_property
    def _series_at(self) -> re.Pattern:
        anywhere = sorted((a for a in self.series if a not in self.capitals), key=len, reverse=True)
        spelled = "|".join(r"\s{1,3}".join(map(re.escape, a.split(" "))) for a in anywhere) or r"(?!)"
        shouted = "|".join(sorted((re.escape(a.upper()) for a in self.capitals), key=len, reverse=True)) or r"(?!)"
        return re.compile(rf"\b(?:(?i:{spelled})|(?:{shouted}))\b")

    @cached_property
    def _cased_at(self) -> re.Pattern:
        return re.compile(rf"\b(?:{'|'.join(map(re.escape, self.cased_brands)) or '(?!)'})\b")

    @cached_property
    def _automaton(self) -> ahocorasick.Automaton:
        """First words of all names, with their lengths."""
        out = ahocorasick.Automaton()
        for name in {*self.brands, *self.aliases, *self.series, *(b.lower() for b in self.cased_brands)}:
            word = name.split(" ")[0]
            out.add_word(word, len(word))
        out.make_automaton()
        return out

    #: Letters that match a, i, k or s regardless of case, though their lower case is another one or longer.
    _odd_letters = re.compile("[\u0130\u0131\u017f]")
    _words = re.compile(r"\b(?=\w)")

    def starts(self, text: str) -> list[int]:
        """Positions at which a name may begin, in order: a superset of those where one does."""
        if self._odd_letters.search(text):
            return [m.start() for m in self._words.finditer(text)]
        if not len(self._automaton):
            return []
        return sorted({end - size + 1 for end, size in self._automaton.iter(text.lower())})

    # The words of a model.
    _first = re.compile(r"[\s\-]{1,3}([A-Za-z0-9][A-Za-z0-9\-]{1,24})")
    _more = re.compile(r"\s{1,2}([A-Za-z0-9][A-Za-z0-9\-]{0,24})")
    #: Further words of a model: capitals and digits, any digit, or a hyphen.
    _designator = re.compile(r"[A-Z0-9]+|[A-Za-z0-9]*\d[A-Za-z0-9\-]*|[A-Za-z]+-[A-Za-z0-9\-]+")

    def model_after(self, text: str, at: int) -> list[str]:
        """The words of the model that follows a brand; none if another brand does, or nothing of its form."""
        first = self._first.match(text, at)
        if not first or first[1].lower() in self._all_brands:
            return []
        words, at = [first[1].lower()], first.end()
        while len(words) < 3 and (extra := self._more.match(text, at)):
            if extra[1].lower() in self._all_brands or not self._designator.fullmatch(extra[1]):
                break
            words.append(extra[1].lower())
            at = extra.end()
        return words

    def scan_series(self, text: str) -> dict[str, str]:
        """Series named in a text, with their tiers."""
        return self._read(text)[2]

    def _read(self, text: str) -> tuple[set[str], set[tuple[str, ...]], dict[str, str]]:
        """Brands, (brand, words of its model), and series with their tiers."""
        brands: set[str] = set()
        models: set[tuple[str, ...]] = set()
        series: dict[str, str] = {}
        free = 0  # where the last series ended; they do not overlap
        for at in self.starts(text):
            if found := self._brand_at.match(text, at):
                name = re.sub(r"\s+", " ", found[0].lower())
                brand = self.aliases.get(name, name)
                brands.add(brand)
                if words := self.model_after(text, found.end()):
                    models.add((brand, *words))
            if found := self._cased_at.match(text, at):
                brands.add(found[0].lower())
            if at >= free and (found := self._series_at.match(text, at)):
                free = found.end()
                if entry := self.series.get(re.sub(r"\s+", " ", found[0].lower())):
                    series[entry[0]] = entry[1]
        return brands, models, series

    def scan(self, text: str | None) -> dict[str, list[str]]:
        """The fingerprint of a text: four sorted lists, empty for an empty text."""
        brands, models, series = self._read(text or "")
        eligible = [" ".join(m) for m in models if m[1] not in self.connectors]
        if eligible:
            pairs = {f"{p}|{s}|{'D' if tier == 'distinctive' else 'B'}" for s, tier in series.items() for p in eligible}
        else:
            pairs = {f"*|{s}|B" for s, tier in series.items() if tier == "distinctive" and s not in self.recurring}
        return {"strict": sorted({" ".join(m) for m in models}), "brands": sorted(brands), "series": sorted(series), "pairs": sorted(pairs)}


def fingerprint(lexicon: Lexicon = Lexicon()):
    """A column function from text to its fingerprint."""
    if lexicon.problems():
        raise ValueError("; ".join(lexicon.problems()))

    @pandas_udf(FINGERPRINT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([lexicon.scan(t) for t in texts], columns=["strict", "brands", "series", "pairs"])

    return scan


# ---------------------------------------------------------------- comparisons


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / union)


def similarity(a: Column, b: Column) -> Column:
    """Of two fingerprints: models decide; brands help only where both name several of each."""
    models, brands = jaccard(a["strict"], b["strict"]), jaccard(a["brands"], b["brands"])
    return (
        F.when((F.size(a["strict"]) == 0) | (F.size(b["strict"]) == 0), F.lit(0.0))
        .when((F.size(a["strict"]) <= 1) | (F.size(b["strict"]) <= 1) | (F.size(a["brands"]) < 2) | (F.size(b["brands"]) < 2), models)
        .otherwise(F.greatest(models, brands))
    )


def shared_pairs(a: Column, b: Column) -> Column:
    """struct(any_shared, pairs, any_distinctive) of two fingerprints."""
    shared = F.array_sort(F.array_intersect(a["pairs"], b["pairs"]))
    return F.struct((F.size(shared) > 0).alias("any_shared"), shared.alias("pairs"), F.exists(shared, lambda p: p.endswith("|D")).alias("any_distinctive"))


def safe(fp: Column, items: int = 512, length: int = 220) -> Column:
    """Whether all lists of a stored fingerprint are bounded and hold only short non-empty strings."""
    out = fp.isNotNull()
    for name in ("strict", "brands", "series", "pairs"):
        values = F.coalesce(fp[name], F.array().cast("array<string>"))
        out = out & (F.size(values) <= items) & F.forall(values, lambda v: v.isNotNull() & (v != "") & (F.char_length(v) <= length))
    return F.coalesce(out, F.lit(False))


def parsed_pair(pair: Column, length: int = 100) -> Column:
    """struct(model, series, tier) of a well-formed pair key, else null."""
    parts = F.split(pair, r"\|")
    fits = (F.size(parts) == 3) & F.get(parts, F.lit(2)).isin("B", "D")
    for i in (0, 1):
        fits = fits & (F.char_length(F.get(parts, F.lit(i))).between(1, length))
    return F.when(fits, F.struct(F.get(parts, F.lit(0)).alias("model"), F.get(parts, F.lit(1)).alias("series"), F.get(parts, F.lit(2)).alias("tier")))


def coherent_pairs(fp: Column) -> Column:
    """A candidate's pair keys whose model and series its own lists hold."""
    return F.filter(
        F.coalesce(fp["pairs"], F.array().cast("array<string>")),
        lambda p: F.coalesce(
            parsed_pair(p).isNotNull()
            & ((parsed_pair(p)["model"] == "*") | F.array_contains(fp["strict"], parsed_pair(p)["model"]))
            & F.array_contains(fp["series"], parsed_pair(p)["series"]),
            F.lit(False),
        ),
    )

"""Text in legacy Bengali fonts to Unicode. The font's table is a parameter, `Table`; the repository keeps none.

Only texts, or lines, dense enough in the letters of such fonts go through Python: the frame is split before.

Defined results: null stays null; text that is not dense stays as it is; a line that holds Bengali already stays.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.functions.text import LEGACY_LETTER, legacy_density

DENSE = 0.12
LINE_SOLID, LINE_HIGH, LINE_DENSE, LINE_ENGLISH = 10, 4, 0.07, 2
# Consonants, signs written before and after them, and English function words.
CONSONANTS = "কখগঘঙচছজঝঞটঠডঢণতথদধনপফবভমযরলশষসহড়ঢ়য়ৎংঃঁ"
BEFORE, AFTER = "িৈে", "াোৌৗুূীৃ"
HALANT, CHANDRABINDU, RA = "্", "ঁ", "র"
ENGLISH = "the and of to in for is are was were be on at as by with from this that it or an a has have will not but they we you he she his her their our which when where who what than then into over under".split()


@dataclass(frozen=True)
class Table:
    """A font's table: literal pairs and patterns applied before, the main pairs (longest key first), pairs applied after."""

    main: dict[str, str]
    before: list[tuple[str, str]] = field(default_factory=list)
    patterns: list[tuple[str, str]] = field(default_factory=list)
    after: list[tuple[str, str]] = field(default_factory=list)

    @staticmethod
    def read(path: str) -> Table:
        """From a JSON file with the keys main, before, patterns and after, each a list of pairs."""
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        return Table(dict(map(tuple, d["main"])), *[[tuple(x) for x in d.get(k, [])] for k in ("before", "patterns", "after")])


def _reph(text: str) -> str:
    """B2, first half: ra with halant before the cluster it is spoken before; signs after a halant's consonant."""
    s, i = list(text.replace(HALANT * 2, HALANT)), 0
    signs = set(BEFORE + AFTER)
    while i < len(s):
        if 0 < i < len(s) - 1 and s[i] == RA and s[i + 1] == HALANT and s[i - 1] != HALANT:
            head = i - 1
            while head >= 0 and s[head] in signs:
                head -= 1
            if head >= 0 and s[head] in CONSONANTS:
                while head >= 2 and s[head - 1] == HALANT and s[head - 2] in CONSONANTS:
                    head -= 2
                s[head : i + 2] = [RA, HALANT, *s[head:i]]
                i = head + 2
                continue
        if 0 < i < len(s) - 1 and s[i] == HALANT and (s[i - 1] in signs or s[i - 1] == CHANDRABINDU):
            s[i - 1 : i + 2] = [s[i], s[i + 1], s[i - 1]]
        if 0 < i < len(s) - 1 and s[i] == HALANT and s[i - 1] == RA and (i < 2 or s[i - 2] != HALANT) and s[i + 1] in signs:
            s[i - 1 : i + 2] = [s[i + 1], s[i - 1], s[i]]
        i += 1
    return "".join(s)


def _signs(text: str) -> str:
    """B2, second half: signs typed before their cluster go behind it, two-part signs become one, chandrabindu comes last."""
    s, i = list(text), 0
    while i < len(s):
        if i < len(s) - 1 and s[i] in BEFORE and s[i + 1] not in " \t\n\r":
            j = 1
            while i + j < len(s) - 1 and s[i + j] in CONSONANTS and s[i + j + 1] == HALANT:
                j += 2
            sign, stop = s[i], i + j + 1
            follow = s[stop] if stop < len(s) else ""
            if sign == "ে" and follow in ("া", "ৗ"):
                sign, stop = {"া": "ো", "ৗ": "ৌ"}[follow], stop + 1
            s[i:stop] = [*s[i + 1 : i + j + 1], sign]
            i += j
        if i < len(s) - 1 and s[i] == CHANDRABINDU and s[i + 1] in AFTER:
            s[i], s[i + 1] = s[i + 1], s[i]
        i += 1
    return "".join(s)


class Converter:
    """B1: one text at a time."""

    def __init__(self, table: Table):
        self.table = table
        self.main = re.compile("|".join(map(re.escape, sorted(filter(None, table.main), key=len, reverse=True))) or r"(?!)")
        self.patterns = [(re.compile(p), r) for p, r in table.patterns]

    def __call__(self, text: str) -> str:
        for a, b in self.table.before:
            text = text.replace(a, b)
        for p, r in self.patterns:
            text = p.sub(r, text)
        text = _signs(_reph(self.main.sub(lambda m: self.table.main[m[0]], text)))
        for a, b in self.table.after:
            text = text.replace(a, b)
        return text

    def lines(self, text: str) -> str:
        """Line by line, where a line is legacy text and nothing else, and comes out as Bengali."""
        letter = re.compile("[ -ÿŒ-Ÿƒˆ˜]")
        out = []
        for line in text.split("\n"):
            solid, high = len(re.sub(r"\s", "", line)), len(letter.findall(line))
            if solid >= LINE_SOLID and high >= LINE_HIGH and high / solid >= LINE_DENSE and not re.search("[ঀ-৿]", line) and sum(w in ENGLISH for w in re.findall("[a-z]+", line.lower())) < LINE_ENGLISH:
                got = self(line)
                line = got if re.search("[ঀ-৿]", got) else line
            out.append(line)
        return "\n".join(out)


def converted(rows: DataFrame, column: str, table: Table, mixed: bool = False) -> DataFrame:
    """B3, or with `mixed` B4: `rows` with a text column converted where it is legacy text, and whether it was.

    Rows without such text never leave the JVM.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        c = Converter(table)
        return texts.map(c.lines if mixed else c)

    text = F.coalesce(column, F.lit(""))
    wanted = text.rlike(LEGACY_LETTER) if mixed else legacy_density(text) >= DENSE
    done = rows.where(wanted).withColumn("_new", run(column))
    done = done.withColumn("legacy", F.col("_new") != F.col(column)).withColumn(column, F.col("_new")).drop("_new")
    return rows.where(~wanted).withColumn("legacy", F.lit(False)).unionByName(done)


__all__ = ["Converter", "Table", "converted"]

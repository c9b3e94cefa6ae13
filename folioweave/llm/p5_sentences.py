"""Problem 5: sentence boundaries across languages and scripts.

A full stop is ambiguous after an abbreviation, an initial or a number. Unambiguous occurrences decide: first those in
the same document (a word seen with and without its stop; a capitalised word seen in lower case, or inside a
sentence), then those of the whole corpus, whose counts are a plain aggregation, exact for every word: each document asks for the words
around its own full stops, and a join answers. An abbreviation hardly occurs without its stop, and what follows it goes on
in lower case or with names; after a word that merely ends sentences come words that begin them. Scripts bring their own
terminators; quotations and brackets are taken as wholes.

Defined results: null, empty and blank texts have no sentences; repeated rows of an id count once; an id asked for
that has no chunk gives no rows; offsets are in code points, white space between sentences outside.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.operators.lookup import looked_up
from folioweave.session import cut, small_side
from folioweave.sources.tables import table

# An abbreviation stands without its stop once in so many times at most.
BARE = 50
# A word is judged by what follows it if that was seen so often.
SEEN = 3
# A word that the corpus has in lower case once in so many times at least is no name.
COMMON = 10

# Terminators, quotation marks (a mark may close what another language opens with it), closers.
STOPS = ".!?…。！？।॥؟"
CLOSING = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "‘": "’"}
CLOSERS = "”»」』’\"')]）"
GERMAN_MONTHS = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split())
_EAST = re.compile("[぀-ヿ㐀-鿿]")
_THAI = re.compile("[฀-๿]")
_TOKEN_BEFORE = re.compile(r"[^\s.(\[“„«「\"—–]*(?:\.[^\s.(\[“„«「\"]+)*$")
_NEXT = re.compile(r"[\s]*[(“„«「\"'¿¡\[]*([^\s.,;:!?…。！？।؟”»」)\]’'\"]*)")
_FIELD, _ROW = "\x1f", "\x1e"  # no word holds them: they are white space
_WITHIN = re.compile("[!?…。！？।॥؟”»」』)）]")
_OCCUR = re.compile(r"([^\W\d_][^\s.,;:!?…।()\[\]“”„«»\"]*)(\.?)(?:[”»)\"’]*)(\s+|$)(?:[“„«(\"¿¡]*)([^\W_]?)([^\s.,;:!?…।()\[\]“”„«»\"]*)")


def occurrences(text: str) -> Iterator[tuple[str, str]]:
    """(kind, key) of every occurrence that says something about a word:
    dot/bare: a word with or without its stop; low/cap: what follows the stop; pair: stop and next word;
    start/inside/lower: where a word stands and how it is written."""
    before_end = True
    for m in re.finditer(r"\S+", text):
        raw = m[0].lstrip("(“„«\"¿¡'‘[—–-")
        word = raw.rstrip("”»)\"’',;:!?…।]—")
        tail = raw[len(word) :]
        core = word.rstrip(".")
        dotted = word.endswith(".") and not word.endswith("..")
        if core and core[0].isalpha():
            base = core[:-2] if core.endswith(("'s", "’s")) else core
            if base[0].isupper():
                yield ("start" if before_end else "inside"), base
            elif base[0].islower():
                yield "lower", base
            after = text[m.end() : m.end() + 40].lstrip()
            nxt = after.lstrip("(“„«\"¿¡'‘[—–-")[:24].split()
            if dotted and not tail:
                yield "dot", core
                if nxt:
                    first = nxt[0]
                    if first[0].islower() or first[0].isdigit():
                        yield "low", core
                    elif first[0].isalpha():
                        yield "cap", core
                        yield "pair", core + " " + first.rstrip(".,;:!?”»)'")
            elif not dotted:
                yield "bare", core
        before_end = (bool(tail) and any(c in "!?…।" for c in tail)) or (dotted and len(core) > 4 and core[-1:].islower()) or text[m.end() : m.end() + 2] == "\n\n"


class Knowledge:
    """Counts by kind and key."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.counts = counts

    def __call__(self, kind: str, key: str) -> int:
        return self.counts.get((kind, key), 0)


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(kind, word, n) over all texts, and of every word with a stop how many of the capitalised words after it are names
    and how many begin sentences elsewhere (kinds `names` and `starts`)."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got: Counter = Counter()
            for t in b["text"]:
                got.update(occurrences(t))
            yield pd.DataFrame([(k, w, n) for (k, w), n in got.items()], columns=["kind", "word", "n"])

    got = cut(texts.where("text is not null").select("text").mapInPandas(part, "kind string, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n")))
    pairs = got.where("kind = 'pair'").select(F.substring_index("word", " ", 1).alias("a"), F.substring_index("word", " ", -1).alias("w"), "n")
    place = got.where("kind in ('start', 'inside')").groupBy(F.col("word").alias("w")).agg(F.sum(F.when(F.col("kind") == "start", F.col("n")).otherwise(0)).alias("start"), F.sum(F.when(F.col("kind") == "inside", F.col("n")).otherwise(0)).alias("inside"))
    low = got.where("kind = 'lower'").select(F.col("word").alias("l"), F.col("n").alias("low"))
    head = F.substring("w", 1, 1)
    told = pairs.where((F.upper(head) == head) & (F.lower(head) != head)).join(place, "w", "left").join(low, F.lower("w") == F.col("l"), "left")
    low, start, inside = (F.coalesce(c, F.lit(0)) for c in ("low", "start", "inside"))
    begins = ((low > 0) & (COMMON * low >= start + inside)) | (start > 3 * inside)
    after = told.groupBy("a", F.when(begins, "starts").otherwise("names").alias("kind")).agg(F.sum("n").alias("n"))
    return got.unionByName(after.select("kind", F.col("a").alias("word"), "n"))


def words_asked(text: str) -> set[str]:
    """Every word, and pair of words, whose counts the boundaries of a text may depend on."""
    out = set()
    for m in re.finditer("[.…!?]+", text):
        tokens = {_TOKEN_BEFORE.search(text, max(0, i - 40), i)[0].strip("‘’'\"“„«(") for i in range(m.start(), m.end())}
        tokens |= {_WITHIN.split(t)[-1] for t in tokens}  # a sentence may begin without a space before it
        at = m.end()
        while at < len(text) and text[at] in CLOSERS:
            at += 1
        nxt = _NEXT.match(text, at)[1]
        out |= {nxt, nxt.lower(), *tokens, *(f"{t} {nxt}" for t in tokens)}
    return out - {""}


class Splitter:
    def __init__(self, corpus: Knowledge):
        self.corpus = corpus

    def __call__(self, text: str) -> list[tuple[int, int]]:
        own = Knowledge(Counter(occurrences(text)))
        return [s for a, b in self._blocks(text) for s in self._block(text, a, b, own)]

    @staticmethod
    def _blocks(text: str) -> Iterator[tuple[int, int]]:
        """Stretches no sentence goes beyond: paragraphs; single lines where the text has no sentence marks."""
        marked = re.search(r"[!?…。！？।॥؟]|\.(?=[\s”»)\"’]|$)", text)
        at = 0
        lines = []
        for line in text.split("\n"):
            lines.append((at, at + len(line)))
            at += len(line) + 1
        joined: list[list[int]] = []
        for i, (a, b) in enumerate(lines):
            line = text[a:b]
            if not line.strip():
                joined.append([a, b])
                continue
            prev = text[lines[i - 1][0] : lines[i - 1][1]] if i else ""
            alone = not marked or not prev.strip() or len(_THAI.findall(line)) >= 3 or len(_THAI.findall(prev)) >= 3
            if joined and not alone:
                joined[-1][1] = b
            else:
                joined.append([a, b])
        yield from ((a, b) for a, b in joined if text[a:b].strip())

    def _block(self, text: str, a: int, b: int, own: Knowledge) -> list[tuple[int, int]]:
        out, start, i = [], a, a
        thai = len(_THAI.findall(text[a:b])) >= 3
        while i < b:
            c = text[i]
            end = None
            opens = CLOSING.get(c)
            if opens and not (c == "“" and self._closes(text, i)):
                j = text.find(opens, i + 1, b)
                if j < 0:  # never closed: an ordinary character
                    i += 1
                    continue
                end = self._after_quote(text, i, j, b)
                i = j + 1
            elif c in "(（":
                j = min((k for k in (text.find(z, i + 1, b) for z in ")）") if k >= 0), default=-1)  # widths may be mixed
                if j < 0:
                    i += 1
                    continue
                alone = not text[start:i].strip() and text[j - 1] in STOPS
                i = j + 1
                if alone:
                    end = i
            elif c in STOPS:
                j = i
                while j + 1 < b and text[j + 1] in STOPS:
                    j += 1
                if not thai and self._ends(text, i, j, start, b, own):
                    j += 1
                    while j < b and text[j] in CLOSERS and not (text[j] == "(" or text[j] == "'" and text[j + 1 : j + 2].isalpha()):
                        j += 1
                    end = j
                i = j + 1 if end is None else end
            else:
                i += 1
                continue
            if end is None:
                continue
            out.append((start, end))
            start = i = end
        out.append((start, b))
        trimmed = []
        for s, e in out:
            piece = text[s:e]
            if piece.strip():
                trimmed.append((s + len(piece) - len(piece.lstrip()), s + len(piece.rstrip())))
        return trimmed

    @staticmethod
    def _closes(text: str, i: int) -> bool:
        """Whether “ at i closes a German quotation: a letter or stop stands before it."""
        return i > 0 and not text[i - 1].isspace() and text[i - 1] not in "(：:" and "„" in text[max(0, i - 300) : i] and not _EAST.match(text[i - 1])

    def _after_quote(self, text: str, i: int, j: int, b: int) -> int | None:
        """End of the sentence if the quotation text[i..j] ends it."""
        k = j + 1
        inner = text[i + 1 : j].rstrip()
        rest = text[k:b]
        if not inner or inner[-1] not in STOPS:
            return None
        if rest[:1] in ("。", "！", "？", ".", "!", "?", "।"):
            return None
        follow = rest.lstrip()
        if not follow:
            return b
        f = follow[0]
        if _EAST.match(f) and not rest[:1].isspace():
            if text[j] == "」":
                return None if "぀" <= f <= "ゟ" else k
            return k if inner[-1] in "。." else None
        if f.islower() or f in ",;:—–-，、،":
            return None
        return k

    def _ends(self, text: str, i: int, j: int, start: int, b: int, own: Knowledge) -> bool:
        c = text[i]
        rest = text[j + 1 : b]
        after = rest.lstrip(CLOSERS)
        if c in "。！？॥":
            return True
        if not rest.strip():
            return True
        spaced = after[:1].isspace()
        m = _NEXT.match(after)
        nxt = m[1] if m else ""
        lead = after.strip()[:1]
        if c in "।؟":
            return spaced or bool(_EAST.match(lead))
        if c in "!?":
            return (spaced and not lead.islower() and lead not in ",;:—–)") or bool(_EAST.match(lead))
        if c == "…" or j > i:  # an ellipsis ends a sentence only if what follows begins one
            return spaced and lead.isupper() and text[i - 1 : i].isalpha() and self._begins(nxt, own)
        if not spaced and not _EAST.match(lead):
            return False
        if lead.islower() or lead in ",;:—–)%":
            return False
        return self._full_stop(text, i, start, nxt, lead, own)

    def _begins(self, word: str, own: Knowledge) -> bool:
        """Whether a capitalised word begins sentences rather than names."""
        low = word.lower()
        for k in (own, self.corpus):
            s, n = k("start", word), k("inside", word)
            if k("lower", low) and (k is own or COMMON * k("lower", low) >= s + n):
                return True
            if s + n >= (1 if k is own else 3) and (n or s >= 3):
                return s > n
        return False

    def _abbreviation(self, word: str, own: Knowledge) -> bool:
        if own("low", word) or (own("dot", word) and own("bare", word)):
            return bool(own("low", word)) and not own("bare", word)
        dot, bare, low, names, starts = (self.corpus(k, word) for k in ("dot", "bare", "low", "names", "starts"))
        if len(word) <= 6 and dot > 0 and BARE * bare <= dot:
            return low * 4 >= dot or (dot >= SEEN and (names > 2 * starts and names * 2 >= self.corpus("cap", word) if names + starts else len(word) <= 4))
        return dot > 0 and dot >= 9 * bare and low * 4 >= dot and len(word) <= 8

    def _full_stop(self, text: str, i: int, start: int, nxt: str, lead: str, own: Knowledge) -> bool:
        token = _TOKEN_BEFORE.search(text[max(start, i - 40) : i])[0].strip("‘’'\"“„«(")
        if not token:
            return True
        east = bool(_EAST.match(lead))
        if token[-1].isdecimal():
            number = re.search(r"\d+$", token)[0]
            return not (nxt in GERMAN_MONTHS and len(number) <= 2 and token == number)
        if lead.isdigit():
            return not (self._abbreviation(token, own) or len(token) == 1 or self.corpus("low", token) > 0)
        letters = token.replace(".", "")
        if len(letters) == 1 or re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", token):
            return self._initial(text, i, token, start, nxt, lead, own, east)
        if not self._abbreviation(token, own) or east:
            return True
        # A known abbreviation before a capital: it ends the sentence unless it leads names, or goes with this next word.
        cap, low, pair = self.corpus("cap", token), self.corpus("low", token), self.corpus("pair", f"{token} {nxt}")
        if self._titles(token):
            return False
        if pair >= 3 and pair * 4 >= cap + low and not self._begins(nxt, own):
            return False
        return self._begins(nxt, own) or low * 2 >= cap or pair * 10 < max(cap, 1)

    def _titles(self, token: str) -> bool:
        """Whether names follow an abbreviation: few of the words after it begin sentences, and hardly any is in lower case."""
        names, starts, low, cap = (self.corpus(k, token) for k in ("names", "starts", "low", "cap"))
        return cap > 0 and names > 4 * starts and low * 4 < cap and len(token) <= 6

    def _initial(self, text: str, i: int, token: str, start: int, nxt: str, lead: str, own: Knowledge, east: bool) -> bool:
        """A single letter, or letters with stops between, before a capital."""
        if token[-1].islower() and "." in token:  # hours
            return True
        if self._titles(token) and len(token) == 1 and not _LATIN_CAPITAL.match(token):
            return False
        before = text[max(start, i - 60) : i - len(token)].rstrip()
        prev = re.search(r"[^\s]+$", before)
        last = prev[0] if prev else ""
        if east:
            return False
        if token[-1].islower():
            return self._begins(nxt, own)
        if last.endswith(","):  # a surname, then the initial
            return True
        if not last or not last[0].isupper() or last.endswith("."):
            return False
        # Name and initial: does the name come with a following initial elsewhere, and does the next word begin sentences?
        return self._begins(nxt, own) or (own("lower", nxt.lower()) > 0)


_LATIN_CAPITAL = re.compile("[A-ZÀ-ÖØ-ÞА-Я]")


def sentences(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, sent_start, sent_end) of every sentence of the chunks asked for; statistics over all chunks."""
    counts = corpus_counts(chunks)
    mine = cut(chunks.where("text is not null").join(small_side(asked.select("id").where("id is not null").distinct()), "id", "left_semi").select("id", "text").dropDuplicates(["id"]))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, w) for i, t in zip(b["id"], b["text"]) for w in words_asked(t)], columns=["id", "word"])

    # One row a word, and one line of text a text, cross to Python more cheaply than structs do.
    by_word = counts.groupBy("word").agg(F.array_join(F.collect_list(F.concat_ws(":", "kind", "n")), " ").alias("told"))  # at most one entry a kind
    told = looked_up(mine.where(F.col("text").rlike("[.…!?]")).mapInPandas(ask, "id string, word string"), by_word, "word")
    known = told.groupBy("id").agg(F.array_join(F.collect_list(F.concat_ws(_FIELD, "word", "told")), _ROW).alias("known"))  # what one text asked for

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, k in zip(b["id"], b["text"], b["known"]):
                held = {}
                for row in k.split(_ROW) if k else ():
                    word, _, counted = row.partition(_FIELD)
                    for x in counted.split(" "):
                        kind, _, n = x.partition(":")
                        held[kind, word] = int(n)
                rows += [(i, s, e) for s, e in Splitter(Knowledge(held))(t)]
            yield pd.DataFrame(rows, columns=["id", "sent_start", "sent_end"])

    return mine.join(known, "id", "left").mapInPandas(part, "id string, sent_start long, sent_end long")


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p5_found: sentences of the chunks in sent_sample."""
    return sentences(table(spark, folder, "chunks", "id", "text"), table(spark, folder, "sent_sample", "id"))


def all_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """p5_sentences: the same for every chunk."""
    chunks = table(spark, folder, "chunks", "id", "text")
    return sentences(chunks, chunks.select("id"))


QUERIES = {"p5_found": found, "p5_sentences": all_sentences}
SQL: dict[str, str] = {}

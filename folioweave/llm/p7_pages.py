"""Problem 7: traces of the printed page in text from scanned files.

Lines are labelled header, body or break by a hidden Markov model. A line's symbol joins its form (blank, page number,
capitals, short title, short, long, markup), whether it stands at an edge of its text, and whether REPEATS texts hold
it. The model starts from plain beliefs and is re-estimated from the whole corpus (Baum-Welch; what comes back from a
pass is 3 x 3 and 3 x symbols numbers). The most probable labels give the repair: headers go, and the body's lines are
joined into paragraphs, where words broken at line ends are put together and misread letters are set right if the
corpus has the repaired word far more often than the broken one.

Counts are exact. Words of at least RATE of the corpus, at most 1 / RATE of them, are broadcast; of rarer ones each text
asks for those it needs, and a join answers. What a misread token may have been is worked out once for each distinct one.
Which words are broadcast changes the work and not the rows: every count that a repair depends on is broadcast or asked for.

Defined results: null and empty texts are clean; repeated rows give one result row; wrapped lines alone are clean.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import ChainMap
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.operators.lookup import looked_up
from folioweave.session import cut
from folioweave.sources.tables import table

RATE = 5e-6
# A word is known if it occurs so often; a repair's word so often, and so many times as often as what it replaces.
KNOWN, EVIDENCE, TIMES = 6, 24, 20
# The longest string that is taken for a word.
WORD = 40
# A line is a running header's if so many texts hold it.
REPEATS = 5
HEADER, BODY, BREAK = range(3)
FORMS = ["blank", "number", "numbered", "capitals", "title", "short", "long", "markup"]
SYMBOLS = len(FORMS) * 4

# How pages are numbered, in the languages of the corpus.
PAGE_WORDS = "page|pg|p|seite|s|pág|pagina|página|стр|с|পৃষ্ঠা|पृष्ठ|صفحة|ص|หน้า"
_NUM = "[0-9০-৯०-९٠-٩OolI|]{1,5}"
_NUMBER = re.compile(rf"^(?:[-—–\[(.•·|\s]*(?:(?:{PAGE_WORDS})\.?\s*)?\d{{1,5}}(?:\s*(?:/|\||of|von|de|из)\s*\d{{1,5}})?[-—–\])\s.•·|]*|第\s*\d{{1,5}}\s*[页頁])$", re.I)
_MARKUP = re.compile(r"^\s*(?:[#*+|>{}\\;%:<=$`~]|-\s|\d+[.)]\s|__|\[\^|</?\w|!\[)|</\w+>\s*$|[{};]\s*$|^[=\-~*_]{3,}$|\\\\$|^\s{4}\S|^\w+: \d+$|^Links:|=")
_END = re.compile(r"[.!?。！？।؟:][\"”»“’)」]*\s*$")
_LETTER = re.compile(r"[^\W\d_]")
_HAN = "぀-ヿ一-鿿"
_THAI = re.compile("[\u0e00-\u0e7f]{3}")
# Invisible characters within words; a soft hyphen at a line's end is one of the page's hyphens and stays.
_UNSEEN = re.compile("[\u200b\u2060\ufeff]|\u00ad(?!\\s*\n)|(?<=[A-Za-z])[\u200c\u200d](?=[A-Za-z])")
HYPHENS = "-‐¬­"

# What scanners take one letter, or pair of letters, for (read -> meant).
CONFUSED = [("c", "e"), ("o", "a"), ("b", "h"), ("j", "i"), ("f", "t"), ("q", "g"), ("0", "o"), ("1", "l"), ("1", "i"), ("|", "l"), ("I", "l"), ("l", "I"), ("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("m", "in"), ("m", "rn"), ("d", "cl"), ("h", "b"), ("e", "c"), ("a", "o"), ("t", "f"), ("g", "q"), ("i", "j"), ("5", "s"), ("0", "O"), ("n", "ri"), ("u", "ii"), ("w", "vv"), ("li", "h"), ("h", "li"), ("6", "b"), ("S", "5")]


def plain(line: str) -> str:
    """A line as running headers repeat it: numbers masked, misread digits undone, spaces collapsed."""
    return re.sub(r"\s+", " ", re.sub(r"[\d০-৯]+", "#", line.replace("0", "O"))).strip(" #[]().-—–|/").lower()


def form(line: str, width: int) -> int:
    s = line.strip()
    if not s:
        return 0
    if _NUMBER.match(s):
        return 1
    if _MARKUP.search(line):
        return 7
    if _END.search(s) and not re.search(r"\s{3,}", s):
        return 6 if len(s) > 0.6 * width else 5
    parts = [x for x in re.split(r"\s{2,}", s) if x]
    if len(parts) == 2 and any(_NUMBER.match(x) for x in parts):
        return 2
    letters = _LETTER.findall(s)
    few = len(s.split()) <= 7 and len(s) <= (24 if _THAI.search(s) else 40)
    if few and len(letters) >= 4 and all(c.upper() == c for c in letters) and any(c.lower() != c for c in letters):
        return 3
    if few and letters and (s[0].isupper() or s[0].lower() == s[0].upper()):
        return 4
    return 6 if len(s) > 0.6 * width else 5


# What opens and what closes a stretch of code, table or formula.
_FENCES = [("```", "```"), ("~~~", "~~~"), ("$$", "$$"), ("\\[", "\\]"), ("<pre", "</pre>"), ("<syntaxhighlight", "</syntaxhighlight>"), ("<math", "</math>"), ("<table", "</table>"), ("\\begin{", "\\end{"), ("{|", "|}"), ("{{", "}}")]


def _fenced(lines: list[str]) -> list[bool]:
    """Which lines lie within code, tables or formulas; a stretch that nothing closes is none."""
    out, i = [False] * len(lines), 0
    while i < len(lines):
        s = lines[i].strip()
        for a, b in _FENCES:
            if s.startswith(a):
                j = i if b in s[len(a) :] else next((k for k in range(i + 1, len(lines)) if b in lines[k]), None)
                if j is not None:
                    out[i : j + 1] = [True] * (j + 1 - i)
                    i = j
                break
        i += 1
    return out


def symbols(lines: list[str], repeated: frozenset[str]) -> list[int]:
    width = max(map(len, lines), default=0)
    n = len(lines)
    out = []
    for i, (line, inside) in enumerate(zip(lines, _fenced(lines))):
        f = 7 if inside else form(line, width)
        near = i < 3 or i >= n - 3
        out.append(f * 4 + 2 * near + (f in (2, 3, 4, 5) and not _END.search(line) and plain(line) in repeated))
    return out


def first_model() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, transition and emission probabilities before any text was seen."""
    start = np.array([0.1, 0.85, 0.05])
    move = np.array([[0.4, 0.4, 0.2], [0.03, 0.92, 0.05], [0.25, 0.7, 0.05]])
    emit = np.full((3, SYMBOLS), 1e-3)
    for f, name in enumerate(FORMS):
        for edge in (0, 1):
            for rep in (0, 1):
                k = f * 4 + 2 * edge + rep
                emit[HEADER, k] += {"number": 6.0, "numbered": 6.0}.get(name, 0) + (4.0 if rep and name in ("numbered", "capitals", "title", "short") else 0.0) + (0.05 if name == "capitals" else 0)
                emit[BODY, k] += {"long": 10.0, "short": 3.0, "markup": 3.0, "title": 1.5, "capitals": 0.6}.get(name, 0) * (0.02 if rep else 1) + (0.01 if name in ("number", "numbered") else 0)
                emit[BREAK, k] += 8.0 if name == "blank" else 0
    return start, move, emit / emit.sum(axis=1, keepdims=True)


def posterior(obs: list[int], model: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward-backward: state posteriors, and summed transition posteriors."""
    start, move, emit = model
    n = len(obs)
    e = emit[:, obs].T
    a, b, scale = np.zeros((n, 3)), np.ones((n, 3)), np.zeros(n)
    a[0] = start * e[0]
    scale[0] = a[0].sum()
    a[0] /= scale[0]
    for t in range(1, n):
        a[t] = (a[t - 1] @ move) * e[t]
        scale[t] = a[t].sum()
        a[t] /= scale[t]
    for t in range(n - 2, -1, -1):
        b[t] = move @ (e[t + 1] * b[t + 1]) / scale[t + 1]
    gamma = a * b
    xi = sum((np.outer(a[t], e[t + 1] * b[t + 1]) * move / scale[t + 1] for t in range(n - 1)), np.zeros((3, 3)))
    return gamma, xi


def viterbi(obs: list[int], model: tuple) -> list[int]:
    start, move, emit = (np.log(x + 1e-12) for x in model)
    best, back = start + emit[:, obs[0]], []
    for o in obs[1:]:
        step = best[:, None] + move
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + emit[:, o]
    out = [int(best.argmax())]
    for p in reversed(back):
        out.append(int(p[out[-1]]))
    return out[::-1]


def reestimate(rows: DataFrame, model: tuple, trust: float = 50.0) -> tuple:
    """One Baum-Welch pass over all texts (text, repeated); the model before counts as `trust` lines."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        known = functools.lru_cache(50_000)(lambda obs: posterior(list(obs), model))
        total = np.zeros(3 + 9 + 3 * SYMBOLS)
        for b in batches:
            for text, repeated in zip(b["text"], b["repeated"]):
                obs = tuple(symbols(text.split("\n"), _set(repeated)))
                gamma, xi = known(obs)
                total[:3] += gamma[0]
                total[3:12] += xi.ravel()
                for o, g in zip(obs, gamma):
                    total[12 + o :: SYMBOLS][:3] += g
        yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

    got = rows.where(F.instr("text", "\n") > 0).select("text", "repeated").mapInPandas(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros(3 + 9 + 3 * SYMBOLS)
    total[got["k"].to_numpy(dtype=int)] = got["v"]
    start, move, emit = model
    a, b, c = total[:3] + trust * start, total[3:12].reshape(3, 3) + trust * move, total[12:].reshape(3, SYMBOLS) + 20 * trust * emit
    return a / a.sum(), b / b.sum(axis=1, keepdims=True), c / c.sum(axis=1, keepdims=True)


_FIELD, _ROW = "\x1f", "\x1e"  # no word holds them: they are white space


def _pairs(told: str | None) -> Iterator[list[str]]:
    return (x.split(_FIELD) for x in told.split(_ROW)) if told else iter(())


def _set(values) -> frozenset[str]:
    return frozenset() if values is None else frozenset(values)


def word_counts(rows: DataFrame) -> DataFrame:
    """(w, n) of every word, in lower case."""
    return rows.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{M}]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def with_repeated(records: DataFrame) -> DataFrame:
    """records with the lines of each text that at least REPEATS texts hold, as they are compared."""

    @F.pandas_udf("array<string>")
    def short(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [p for p in {plain(x) for x in t.split("\n") if x and not _MARKUP.search(x) and not _END.search(x)} if len(p) >= 3 and _LETTER.search(p)])

    lines = cut(records.where(F.instr("text", "\n") > 0).select("rec_table", "rec_key", F.explode(short("text")).alias("line")))
    often = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= REPEATS).select("line")
    held = looked_up(lines, often, "line").groupBy("rec_table", "rec_key").agg(F.collect_set("line").alias("repeated"))  # lines of one text
    return records.join(held, ["rec_table", "rec_key"], "left")


# A token stands between spaces or marks; East Asian letters beside it are none of its own.
_AROUND = rf"\s\x21-\x7e«»“”„‘’¿¡—。，！？：；「」、（）{_HAN}"
_TOKEN = re.compile(rf"(?<![^\W_{_HAN}])(?<![^{_AROUND}])[^\W_{_HAN}]+(?:[|][^\W_{_HAN}]*)*(?![^{_AROUND}])")


_HYPHENATED = re.compile(rf"(?P<a>[^\W\d_]+)(?:[{HYPHENS}]\s*\n+\s*|[¬]\s+|[-‐­] )(?P<b>[^\W\d_]+)")
_LETTERS = re.compile(rf"[^\W\d_{_HAN}]+")
_MIXED = re.compile(r"[^\W\d_][\d|]|[\d|][^\W\d_]")
_ATTACHED = re.compile(rf"[^\W_{_HAN}]")


def neighbours(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, start, end) of every two runs of letters that only a space or a line's end parts, no digit attached."""
    before = None
    for m in _LETTERS.finditer(text):
        start, end = m.span()
        if end < len(text) and _ATTACHED.match(text[end]) or start and _ATTACHED.match(text[start - 1]):
            before = None
            continue
        if before and start - before[1] == 1 and text[before[1]] in " \n":
            yield (*before, start, end)
        before = start, end


def corrections(token: str) -> Iterator[str]:
    """Every word the token may have been before one or two letters were misread."""
    seen = {token}
    layer = [token]
    for _ in range(1 if len(token) < 6 else 2):
        new = []
        for t in layer:
            for read, meant in CONFUSED:
                i = t.find(read)
                while i >= 0:
                    c = t[:i] + meant + t[i + len(read) :]
                    if c not in seen:
                        seen.add(c)
                        new.append(c)
                        yield c
                    i = t.find(read, i + 1)
        layer = new


def needed(own: int) -> int:
    """How often a word must occur to be what a token seen `own` times was: TIMES as often, and TIMES that if the token
    itself occurs as often as known words do."""
    return TIMES * own * (TIMES if own >= KNOWN else 1)


def best_correction(token: str, own: int, counts: dict[str, int]) -> tuple[str, int] | None:
    """The word that a token, itself seen `own` times, was before it was misread."""
    strange = _strange(token)
    best = None
    for c in corrections(token):
        n = counts.get(c.lower(), 0) if c.isalpha() else 0
        if n > (best[1] if best else 0) and n >= needed(own) and (n >= EVIDENCE or (strange and n >= KNOWN)) and (c[0].isupper() == token[0].isupper() or not token[0].isalpha()):
            best = c, n
    return None if best and token[0].isupper() and not strange and best[1] < 2 * EVIDENCE else best


def _strange(token: str) -> bool:
    return any(c in "01|56" for c in token) or re.search(r"[a-z][A-Z]", token) is not None


def suspicious(token: str) -> bool:
    """Whether a token that is no frequent word may be misread at all; strings longer than words are are none."""
    if len(token) > WORD:
        return False
    letters = sum(c.isalpha() or c in "01|" for c in token)
    return len(token) >= 3 and letters >= 0.7 * len(token) and (token[0].isalpha() or token[0] in "|01") and any(c.islower() for c in token)


class Repair:
    """Repairs one text at a time: `page` takes away what the page added, `mend` joins and corrects words."""

    def __init__(self, model: tuple, head: dict[str, int], doubtful: frozenset[str]):
        self.head, self.doubtful, self.known, self.fixes = head, doubtful, {}, {}
        self.labels = functools.lru_cache(50_000)(lambda obs: viterbi(list(obs), model))

    def count(self, w: str) -> int:
        w = w.lower()
        return self.head.get(w) or self.known.get(w, 0)

    def sound(self, w: str) -> bool:
        """Whether a word, in lower case, is a frequent one that no other is frequent enough to correct."""
        return w in self.head and w not in self.doubtful

    def joins(self, a: str, b: str, hyphen: bool) -> bool:
        """Whether two pieces are one word: the corpus knows it, and not its pieces as neighbours."""
        whole, n = a + b, self.count(a + b)
        known = [self.count(x) >= KNOWN and TIMES * self.count(x) >= n for x in (a, b)]
        if hyphen:
            if all(known) and n < KNOWN:
                return False
            return bool(b) and (b[0].islower() or not b[0].isupper() or whole.isupper()) and (n >= KNOWN or b[0].islower() or b[0].lower() == b[0].upper())
        if len(whole) < 4 or n < KNOWN:
            return False
        return not all(known) or (min(self.count(a), self.count(b)) * TIMES < n and min(len(a), len(b)) <= 2)

    def asks(self, body: str) -> tuple[set[str], set[str]]:
        """Words whose counts the mending of a body needs beside the frequent ones, and tokens that may be misread."""
        words: set[str] = set()
        broken = [*_HYPHENATED.finditer(body)] if any(h in body for h in HYPHENS) else []
        for m in broken:
            x, y = m["a"].lower(), m["b"].lower()
            words |= {w for w in (x, y, x + y) if w not in self.head}
        if not _MIXED.search(body) and all(map(self.sound, map(str.lower, _LETTERS.findall(body)))) and not broken:
            return words, set()
        for text in _as_joined(body, broken):
            for i, j, k, n in neighbours(text):
                x, y = text[i:j].lower(), text[k:n].lower()
                if x not in self.head or y not in self.head:  # two frequent words are never joined to a rarer one
                    words |= {w for w in (x, y, x + y) if w not in self.head}
        return words, {t for t in _TOKEN.findall(body) if suspicious(t) and not self.sound(t.lower())}

    def page(self, text: str, repeated: frozenset[str]) -> tuple[str, bool]:
        """The text without headers and page numbers, and whether there were any."""
        traces: set[str] = set()
        lines = text.split("\n")
        if len(lines) > 1:
            obs = symbols(lines, repeated)
            labels = self.labels(tuple(obs))
            kept = []
            for line, label in zip(lines, labels):
                if label == HEADER:
                    traces.add("header")
                else:
                    kept.append("" if label == BREAK else line)
            lines = kept
        return unicodedata.normalize("NFC", _UNSEEN.sub("", "\n".join(lines).strip("\n"))), bool(traces)

    def mend(self, body: str, known: dict[str, int], fixes: dict[str, str]) -> tuple[str, set[str]]:
        """The body with broken words joined and misread ones set right, and which traces there were."""
        self.known, self.fixes, traces = known, fixes, set()

        def hyphenated(m: re.Match) -> str:
            if self.joins(m["a"], m["b"], True):
                traces.add("broken")
                return m["a"] + m["b"]
            return m[0]

        body = _HYPHENATED.sub(hyphenated, body)

        out, at = [], 0
        for i, j, k, n in neighbours(body):
            if i >= at and self.count(body[i:j] + body[k:n]) >= KNOWN and self.joins(body[i:j], body[k:n], False):
                traces.add("broken")
                out += [body[at:j], body[k:n]]
                at = n
        body = "".join(out) + body[at:]
        east = re.sub(rf"(?<=[{_HAN}][{_HAN}，。：；！？“”]) (?=[{_HAN}，。：；！？“”])|(?<=[{_HAN}，。：；！？“”]) (?=[{_HAN}，。：；！？“”][{_HAN}])|(?<=\d) (?=[\d.]+%)", "", body)
        if east != body and re.search(f"[{_HAN}]", body):
            traces.add("broken")
            body = east

        def letters(m: re.Match) -> str:
            to = self.fixes.get(m[0])
            if to is None:
                return m[0]
            traces.add("misread")
            return to

        return _paragraphs(_TOKEN.sub(letters, body) if self.fixes else body), traces


def _as_joined(body: str, broken: list[re.Match]) -> list[str]:
    """The body with none, all, every second and every other of its broken words joined: whichever are joined in the end,
    any two neighbours are so in one of these."""
    out = [body]
    for take in ({0, 1}, {0}, {1}) if len(broken) > 1 else ({0},) if broken else ():
        parts, at = [], 0
        for i, m in enumerate(broken):
            if i % 2 in take:
                parts += [body[at : m.start()], m["a"], m["b"]]
                at = m.end()
        out.append("".join(parts) + body[at:])
    return out


def _paragraphs(body: str) -> str:
    """Wrapped lines as continuous paragraphs: a line goes on in the next unless either is markup, blank, or short and ended."""
    lines = body.split("\n")
    width = max(map(len, lines), default=0)
    out: list[str] = []
    for i, line in enumerate(lines):
        before = lines[i - 1] if i else ""
        wrapped = i and before.strip() and line.strip() and not _MARKUP.search(before) and not _MARKUP.search(line) and len(before) > 0.6 * width and not (_END.search(before) and len(before) < 0.8 * width)
        if wrapped:
            east = re.search(f"[{_HAN}]$", out[-1]) and re.match(f"[{_HAN}]", line)
            out[-1] += ("" if east else " ") + line.strip()
        else:
            out.append(line)
    return "\n".join(out)


def fit(rows: DataFrame, rounds: int = 2) -> tuple:
    """The model of a corpus of (text, repeated)."""
    model = first_model()
    for _ in range(rounds):
        model = reestimate(rows, model)
    return model


def frequent(words: DataFrame) -> tuple[dict[str, int], float]:
    """Words of at least RATE of all occurrences, at most 1 / RATE of them, with their counts; and that floor."""
    floor = max(KNOWN, RATE * (words.agg(F.sum("n")).first()[0] or 0))
    return {r["w"]: r["n"] for r in words.where(F.col("n") >= floor).collect()}, floor


def doubted(head: dict[str, int], floor: float) -> frozenset[str]:
    """Frequent words that may be misreadings of others; few words are frequent enough to be what another was."""
    back = {(meant.lower(), read.lower()) for read, meant in CONFUSED if read.isalpha() and meant.isalpha()}
    out = set()
    for c, n in head.items():
        if n < needed(floor):
            continue
        seen, layer = {c}, [c]
        for _ in range(2):  # corrections() takes two steps at most
            new = []
            for t in layer:
                for meant, read in back:
                    i = t.find(meant)
                    while i >= 0:
                        w = t[:i] + read + t[i + len(meant) :]
                        if w not in seen:
                            seen.add(w)
                            new.append(w)
                        i = t.find(meant, i + 1)
            layer = new
        out |= {w for w in seen if w in head and n >= needed(head[w])}
    return frozenset(out)


def misreadings(tokens: DataFrame, words: DataFrame, head: dict[str, int]) -> DataFrame:
    """(token, to) of every distinct token (token) that is a misread word."""
    spark = tokens.sparkSession
    width = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = tokens.distinct().withColumn("w", F.lower("token")).join(words, "w", "left").select("token", F.coalesce("n", F.lit(0)).alias("own")).repartition(width)
    held = spark.sparkContext.broadcast(head)

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(t, n, c.lower()) for t, n in zip(b["token"], b["own"]) for c in corrections(t) if c.isalpha() and c.lower() not in held.value], columns=["token", "own", "w"])

    # A repair's word may be rarer than the frequent ones: their counts are joined.
    rest = looked_up(own.mapInPandas(possible, "token string, own long, w string"), words.where(F.col("n") >= KNOWN), "w").groupBy("token").agg(F.map_from_entries(F.collect_set(F.struct("w", "n"))).alias("rest"))
    own = own.join(rest, "token", "left")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(t, best_correction(t, n, ChainMap(dict(r) if r is not None else {}, held.value))) for t, n, r in zip(b["token"], b["own"], b["rest"])]
            yield pd.DataFrame([(t, g[0]) for t, g in got if g], columns=["token", "to"])

    return own.mapInPandas(part, "token string, to string")


def repaired(records: DataFrame) -> DataFrame:
    """records (rec_table, rec_key, text) that bear traces: repaired text and the kinds of traces."""
    spark = records.sparkSession
    rows = cut(with_repeated(records.dropDuplicates(["rec_table", "rec_key"])))
    words = cut(word_counts(rows.select("text")))
    head, floor = frequent(words)
    held = spark.sparkContext.broadcast((fit(rows.select("text", "repeated")), head, doubted(head, floor)))

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair = Repair(*held.value)
        for b in batches:
            out = []
            for t, k, text, lines in zip(b["rec_table"], b["rec_key"], b["text"], b["repeated"]):
                body, header = repair.page(text, _set(lines))
                ws, ts = repair.asks(body)
                out.append((t, k, body, header, sorted(ws), sorted(ts)))
            yield pd.DataFrame(out, columns=["rec_table", "rec_key", "body", "header", "words", "tokens"])

    key = ["rec_table", "rec_key"]
    bodies = cut(rows.select(*key, "text", "repeated").mapInPandas(pages, "rec_table string, rec_key string, body string, header boolean, words array<string>, tokens array<string>"))
    tokens = bodies.select(*key, F.explode("tokens").alias("token"))
    known = looked_up(bodies.select(*key, F.explode("words").alias("w")), words, "w").groupBy(*key).agg(F.array_join(F.collect_list(F.concat_ws(_FIELD, "w", "n")), _ROW).alias("known"))  # what one text asked for
    fixes = looked_up(tokens, cut(misreadings(tokens.select("token"), words, head)), "token").groupBy(*key).agg(F.array_join(F.collect_list(F.concat_ws(_FIELD, "token", "to")), _ROW).alias("fixes"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair = Repair(*held.value)
        for b in batches:
            out = []
            for t, k, body, header, ws, fs in zip(b["rec_table"], b["rec_key"], b["body"], b["header"], b["known"], b["fixes"]):
                text, traces = repair.mend(body, {w: int(n) for w, n in _pairs(ws)}, dict(_pairs(fs)))
                traces |= {"header"} if header else set()
                if traces:
                    out.append((t, k, text, ",".join(sorted(traces))))
            yield pd.DataFrame(out, columns=["rec_table", "rec_key", "repaired", "traces"])

    return bodies.drop("words", "tokens").join(known, key, "left").join(fixes, key, "left").mapInPandas(part, "rec_table string, rec_key string, repaired string, traces string")


def records_of(chunks: DataFrame, conv_results: DataFrame) -> DataFrame:
    a = chunks.select(F.lit("chunks").alias("rec_table"), F.col("id").alias("rec_key"), F.col("text").alias("text"))
    b = conv_results.select(F.lit("conv_results").alias("rec_table"), F.col("conv_id").cast("string").alias("rec_key"), F.col("method").alias("text"))
    return a.unionByName(b).where("rec_key is not null and text is not null and text != ''")


def _repaired(spark: SparkSession, folder: str) -> DataFrame:
    return repaired(records_of(table(spark, folder, "chunks", "id", "text"), table(spark, folder, "conv_results", "conv_id", "method")))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p7_found: records with traces of the page."""
    return _repaired(spark, folder).select("rec_table", "rec_key")


QUERIES = {"p7_found": found, "p7_repaired": _repaired}
SQL: dict[str, str] = {}

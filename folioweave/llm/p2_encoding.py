"""Problem 2: text decoded with the wrong character encoding.

Every (read-as, meant) pair of code pages is a substitution cipher on bytes. Which one acts in a source is
unknown and is learned by expectation-maximisation against letter bigrams of the corpus itself:

* bigram table  - counts over all tokens with a non-ASCII character, hashed into a table of fixed size;
* E step        - per distinct (source, token): the likelihood of the token as it stands and under each cipher;
* M step        - the bigram table is recounted from the readings that won, and each source's weights over
                  ciphers (its byte-to-letter mapping) from the readings' posteriors;
* application   - `str.translate` with the cipher's table for one-byte pages, a decode of the bytes for others.

Defined results: null and empty texts are never garbled; U+FFFD marks a garbled record that can't be restored;
repeated rows give one result row; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.session import cut
from folioweave.sources.tables import table

BUCKETS = 1 << 17  # of each of the two rows of the bigram sketch: 2 MB in all, whatever the corpus
UNIGRAMS = 1 << 16  # one for each character of the basic plane; others share them
SALTS = 16
SIEVE = 1 << 20
BLOCK = 1 << 13  # slots that reach the driver as one row of bytes

# Code pages by their public names. "+" lets the bytes a page leaves undefined pass as C1 controls.
READ_AS = ["latin-1", "cp1252+", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp866", "cp1250", "gb18030"]
MEANT = [
    "utf-8", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp1252", "mac_roman", "cp850", "cp437",
    "cp1250", "cp1253", "cp1256", "cp874", "gb18030", "shift_jis", "euc_jp", "big5", "euc_kr",
]
PAIRS = [(r, m) for r in READ_AS for m in MEANT if r.rstrip("+") != m and (r != "gb18030" or m == "utf-8") and (r, m) != ("latin-1", "cp1252")]
ONE_BYTE = {"cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp1252", "mac_roman", "cp850", "cp437", "cp1250", "cp1253", "cp1256", "cp874"}

# Weight of a cipher that no token has been seen in, and how many tokens the corpus-wide weights count for in a source.
FLOOR = 1e-4
START = 0.01
STRENGTH = 5.0
MARGIN = 1.0

TOKEN_BREAK = "[ \\t\\r\\n\\x{3002}\\x{ff0c}\\x{ff01}\\x{ff1f}]+"
_TOKEN = re.compile("[^ \t\r\n。，！？]+")
_HIGH = re.compile(r"[^\x00-\x7f]")
_RUN = re.compile(r"[^\x00-\x7f]+")
INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")


@functools.cache
def _page(name: str) -> tuple[dict, dict]:
    """Byte -> character and character -> byte of a one-byte page."""
    to = {}
    for b in range(256):
        try:
            to[b] = bytes([b]).decode(name.rstrip("+"))
        except UnicodeDecodeError:
            if name.endswith("+"):
                to[b] = chr(b)
    return to, {ord(c): b for b, c in to.items()}


@functools.cache
def cipher_table(read_as: str, meant: str) -> dict[int, str]:
    """str.translate table of a pair of one-byte pages."""
    _, back = _page(read_as)
    to, _ = _page(meant)
    return {c: to[b] for c, b in back.items() if b in to and b >= 128}


@functools.cache
def _broken(ch: str) -> bool:
    return unicodedata.category(ch) in ("Cc", "Cn", "Co", "Cs") and ch not in "\t\n\r"


def _bytes(s: str, read_as: str) -> bytes | None:
    if read_as == "gb18030":
        try:
            return s.encode(read_as)
        except UnicodeEncodeError:
            return None
    back = _page(read_as)[1]
    try:
        return bytes([back[ord(c)] for c in s])
    except KeyError:
        return None


def decipher(s: str, read_as: str, meant: str) -> str | None:
    """`s` read again with the page that was meant; None where the bytes don't allow it."""
    if meant in ONE_BYTE:
        if read_as == "gb18030":
            return None
        table = cipher_table(read_as, meant)
        if not all(ord(c) < 128 or ord(c) in table for c in s):
            return None
        out = s.translate(table)
    elif meant == "utf-8":
        out, ok = _utf8_runs(s, read_as)
        if not ok:
            return None
    else:
        out = _runs(s, read_as, meant)
        if out is None:
            return None
    return None if out == s or any(map(_broken, out)) else out


def _pieces(s: str, read_as: str) -> list[str | bytes]:
    """`s` in pieces: bytes for a run of characters the page has, some of them high; text for everything else."""
    back, out, i = _page(read_as)[1], [], 0
    while i < len(s):
        j = i
        while j < len(s) and ord(s[j]) in back:
            j += 1
        run = s[i:j]
        if run:
            out.append(run if run.isascii() else bytes([back[ord(c)] for c in run]))
        if j < len(s):
            out.append(s[j])
        i = j + 1
    return out


def _runs(s: str, read_as: str, meant: str, pieces: list[str | bytes] | None = None) -> str | None:
    """Undo a two-byte page in each run of characters the wrong page has, so that clean neighbours may stay."""
    pieces = _pieces(s, read_as) if pieces is None else pieces
    out = None
    for at, x in enumerate(pieces):
        if isinstance(x, bytes):
            try:
                read = x.decode(meant)
            except UnicodeDecodeError:
                continue
            out = out or list(pieces)
            out[at] = read
    if out is None:
        return None
    back = _page(read_as)[0]
    return "".join(x if isinstance(x, str) else "".join(back[b] for b in x) for x in out)


def _utf8_runs(s: str, read_as: str) -> tuple[str, bool]:
    """Undo UTF-8 read as a page in each run of high characters; a run that doesn't decode stays."""
    done = 0

    def once(m: re.Match) -> str:
        nonlocal done
        raw = _bytes(m[0], read_as)
        if raw is None:
            return m[0]
        try:
            out = raw.decode("utf-8")
        except UnicodeDecodeError as e:  # a run may end in the middle, or start with a character that belongs here
            if read_as == "gb18030":
                return m[0]
            out, i = [], 0
            while i < len(raw):
                n = 2 if 0xC2 <= raw[i] < 0xE0 else 3 if 0xE0 <= raw[i] < 0xF0 else 4 if 0xF0 <= raw[i] < 0xF5 else 0
                try:
                    out.append(raw[i : i + n].decode("utf-8") if n and len(raw) >= i + n else "")
                except UnicodeDecodeError:
                    out.append("")
                if out[-1]:
                    i += n
                    done += 1
                else:
                    out[-1] = m[0][i]
                    i += 1
            return "".join(out)
        done += 1
        return out

    return _RUN.sub(once, s), done > 0


_ONE_BYTE_PAIRS = [(k, cipher_table(r, m)) for k, (r, m) in enumerate(PAIRS) if m in ONE_BYTE and r != "gb18030"]
_OTHER_PAIRS = [(r, [(k, m) for k, (s, m) in enumerate(PAIRS) if s == r and m not in ONE_BYTE]) for r in READ_AS]


@functools.cache
def _utf8_parts(ch: str) -> tuple[int, int]:
    """In which pages (a bit each) a character is a first, and a later, byte of UTF-8."""
    first = later = 0
    for i, r in enumerate(READ_AS):
        b = _page(r)[1].get(ord(ch)) if r != "gb18030" else None
        if b is not None:
            first |= (0xC2 <= b < 0xF5) << i
            later |= (0x80 <= b < 0xC0) << i
    return first, later


class _Reader:
    """Decipherments of tokens; what a character can be under each pair is worked out once."""

    def __init__(self, known: Callable[[str], bool]):
        self.known, self.held = functools.cache(known), {}

    def _char(self, ch: str) -> tuple[int, int]:
        """Pairs of one-byte pages (a bit each) that give the character a meaning, and those that give a known one."""
        got = self.held.get(ch)
        if got is None:
            fit = seen = 0
            for i, (_, t) in enumerate(_ONE_BYTE_PAIRS):
                to = t.get(ord(ch))
                if to is not None and not any(map(_broken, to)):
                    fit |= 1 << i
                    seen |= all(map(self.known, to.lower())) << i
            got = self.held[ch] = fit, seen
        return got

    def __call__(self, token: str) -> dict[str, list[int]]:
        out: dict[int, str] = {}
        high = {c for c in token if ord(c) > 127}
        if not any(ord(c) < 128 and _broken(c) for c in token):
            chars = [self._char(c) for c in high]
            fit = functools.reduce(int.__and__, (f for f, _ in chars), -1) if chars else 0
            if len(chars) < 5:  # not one may be unknown
                fit = functools.reduce(int.__and__, (s for _, s in chars), fit)
            while fit > 0:
                i = (fit & -fit).bit_length() - 1
                fit &= fit - 1
                if sum(not s >> i & 1 for _, s in chars) * 5 <= len(chars):
                    k, table = _ONE_BYTE_PAIRS[i]
                    d = token.translate(table)
                    if d != token:
                        out[k] = d
        self._others(token, high, out)
        by: dict[str, list[int]] = {}
        for k in sorted(out):
            by.setdefault(out[k], []).append(k)
        return by

    def _others(self, token: str, high: set[str], out: dict[int, str]) -> None:
        many = sum(ord(c) > 127 for c in token) >= 2
        first = later = 0
        for c in high:
            a, b = _utf8_parts(c)
            first, later = first | a, later | b
        held: dict[tuple, dict[str, str | None]] = {}  # pages that give the same bytes give the same readings
        for i, (r, pairs) in enumerate(_OTHER_PAIRS):
            if r == "gb18030":
                tries = [(k, self._utf8(token, r)) for k, _ in pairs]
            elif not many or not any(ord(c) in _page(r)[1] for c in high):
                continue
            else:
                pieces = _pieces(token, r)
                got = held.setdefault(tuple(pieces), {})
                tries = []
                for k, m in pairs:
                    if m != "utf-8":
                        if m not in got:
                            got[m] = self._two_bytes(token, r, m, pieces)
                        tries.append((k, got[m]))
                    elif (first & later) >> i & 1:
                        tries.append((k, self._utf8(token, r)))
            for k, d in tries:
                if d is not None:
                    out[k] = d

    def _seen(self, d: str) -> str | None:
        """A reading if nearly all its characters are known."""
        return d if sum(not self.known(c) for c in d.lower()) * 8 <= len(d) else None

    def _two_bytes(self, token: str, r: str, m: str, pieces: list[str | bytes]) -> str | None:
        d = _runs(token, r, m, pieces)
        return None if d is None or d == token or any(map(_broken, d)) else self._seen(d)

    def _utf8(self, token: str, r: str) -> str | None:
        d = decipher(token, r, "utf-8")
        if d is None:
            return None
        return self._seen((decipher(d, r, "utf-8") or d) if _HIGH.search(d) else d)  # it may be twice misread


@functools.lru_cache(4)
def _reader(known: Callable[[str], bool]) -> _Reader:
    return _Reader(known)


def _any(ch: str) -> bool:
    return True


def readings(token: str, known: Callable[[str], bool] = _any) -> dict[str, list[int]]:
    """Each distinct decipherment of a token nearly all whose characters are known -> indexes of all pairs that give it."""
    return _reader(known)(token)


# Cyrillic and Greek letters that look like the Latin one beneath; they are no sign of a wrong page.
_ALIKE = "аесорхуіјѕһԁԛԝАВЕКМНОРСТХУІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧοντ"
_LATIN = "aecopxyijshdqwABEKMHOPCTXYIJSABEZHIKMNOPTYXovt"
_TO_LATIN = {ord(a): b for a, b in zip(_ALIKE, _LATIN)}
_TO_CYRILLIC = {ord(b): a for a, b in zip(_ALIKE, _LATIN) if "а" <= a <= "я" or "А" <= a <= "Я"}
_LETTERS = re.compile("[A-Za-z]")
_STRICT_CYRILLIC = re.compile("[бвгджзийклмнптфцчшщъыьэюяБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯ]")


def _fold(token: str) -> str:
    """A token as it looks: no invisible characters, letters composed, look-alikes of one script."""
    t = unicodedata.normalize("NFKC", INVISIBLE.sub("", token))
    if _LETTERS.search(t):
        t = _WORD.sub(_one_script, t)
    return t.lower()


_WORD = re.compile(r"[^\W\d_]+")


def _one_script(m: re.Match) -> str:
    w = m[0]
    if w.isascii() or not _LETTERS.search(w):
        return w if w.isascii() or _STRICT_CYRILLIC.search(w) else w.translate(_TO_LATIN) if len(w) == 1 else w
    return w.translate(_TO_CYRILLIC if _STRICT_CYRILLIC.search(w) else _TO_LATIN)


@functools.lru_cache(1 << 18)
def _pair_slots(two: str) -> tuple[int, int]:
    h = zlib.crc32(two.encode("utf-16-le", "surrogatepass"))
    return h % BUCKETS, BUCKETS + (h * 0x9E3779B1 & 0xFFFFFFFF) // (1 << 15) % BUCKETS


def _slots(s: str) -> tuple[list[int], list[int]]:
    """Slots of a folded token's bigrams (two each, one in each row of the sketch), and of its characters."""
    s = f" {s} "
    two = []
    for i in range(len(s) - 1):
        two += _pair_slots(s[i : i + 2])
    return two, [ord(c) % UNIGRAMS for c in s]


# Weight that a cipher of UTF-8 has before anything is known: the bytes' form alone is evidence.
_FIRST = {k: START for k, (r, m) in enumerate(PAIRS) if m == "utf-8" and r in ("latin-1", "cp1252+", "mac_roman", "cp437", "gb18030")}
# Pages in which UTF-8 leaves sequences that clean text hardly has; the EM starts from their being garbled.
_TELLING = ["latin-1", "cp1252+", "mac_roman", "cp437"]


def _start(token: str) -> str:
    first = later = 0
    for c in token:
        if ord(c) > 127:
            a, b = _utf8_parts(c)
            first, later = first | a, later | b
    for r in _TELLING:
        d = decipher(token, r, "utf-8") if (first & later) >> READ_AS.index(r) & 1 else None
        if d is not None:
            return decipher(d, r, "utf-8") or d
    return token


def _gathered(slots: DataFrame, size: int, dtype: type) -> np.ndarray:
    """The sums of n by slot (slot, n) as one array. A row for each slot would take the driver some hundred times the
    array's memory once the slots are full; blocks of bytes take the array's own."""

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(BLOCK, dtype=dtype)
        block[b["slot"].to_numpy(dtype=int) % BLOCK] = b["n"].to_numpy(dtype=dtype)
        return pd.DataFrame({"block": [b["slot"].iloc[0] // BLOCK], "bytes": [block.tobytes()]})

    sums = slots.groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(-(-size // BLOCK) * BLOCK, dtype=dtype)
    for r in sums.groupBy(F.floor(F.col("slot") / BLOCK)).applyInPandas(pack, "block long, bytes binary").collect():  # at most size / BLOCK rows
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["bytes"], dtype=dtype)
    return out[:size]


def count_bigrams(tokens: DataFrame, column: str = "reading", weight: str = "n", read: Callable[[str], str] = str) -> tuple[np.ndarray, np.ndarray]:
    """Bigram and character counts over all rows; 2 * BUCKETS + UNIGRAMS numbers reach the driver, in blocks."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        two, one = np.zeros(2 * BUCKETS), np.zeros(UNIGRAMS)
        for b in batches:
            for tok, n in zip(b[column], b[weight]):
                s2, s1 = _slots(_fold(read(tok)))
                for x in s2:
                    two[x] += n
                for x in s1:
                    one[x] += n
        both = np.concatenate([two, one])
        at = both.nonzero()[0]
        yield pd.DataFrame({"slot": at, "n": both[at]})

    both = _gathered(tokens.select(column, weight).mapInPandas(part, "slot long, n double"), 2 * BUCKETS + UNIGRAMS, np.float64)
    return both[: 2 * BUCKETS], both[2 * BUCKETS :]


class Bigrams:
    """log P(next character | character), smoothed towards the next character's own frequency."""

    def __init__(self, two: np.ndarray, one: np.ndarray):
        self.two, self.one, self.total = two, one, float(one.sum()) + 1.0
        self.step = functools.lru_cache(1 << 18)(self._step)

    def known(self, ch: str) -> bool:
        return self.one[ord(ch) % UNIGRAMS] > 0

    def _step(self, two: str) -> float:
        x, y = _pair_slots(two)
        a, b = float(self.one[ord(two[0]) % UNIGRAMS]), float(self.one[ord(two[1]) % UNIGRAMS])
        both = min(float(self.two[x]), float(self.two[y]), a, b)
        return math.log((both + 2.0 * (b + 0.02) / self.total) / (a + 2.0))

    def score(self, folded: str) -> float:
        s, step = f" {folded} ", self.step
        return sum([step(s[i : i + 2]) for i in range(len(s) - 1)])


def judged(token: str, lm: Bigrams) -> tuple[float, list[tuple[int, str, float]]]:
    """Score of a token as it stands, and all its decipherments (pair, reading, score) that some weight of a cipher, which
    is at most 1, may make win: those that score higher."""
    plain = lm.score(_fold(token))
    got = [(ks, d, lm.score(d.lower())) for d, ks in readings(token, lm.known).items()]
    return plain, sorted(((k, d, score) for ks, d, score in got if score > plain for k in ks), key=lambda x: (-x[2], x[0]))


def _best(token: str, lm: Bigrams, weights: dict[int, float]) -> tuple[str, int, float, bool]:
    """The reading with the greatest posterior, its pair (-1: as it stands), its lead in nats, and whether some source's
    weights could make a decipherment win."""
    plain, got = judged(token, lm)
    best = token, -1, 0.0
    for k, d, score in got:
        lead = score - plain + math.log(max(weights.get(k, 0.0), _FIRST.get(k, FLOOR)))
        if lead > best[2]:
            best = (d, k, lead)
    return *best, bool(got)


def token_counts(records: DataFrame) -> DataFrame:
    """(source, token, n) over every token with a non-ASCII character."""
    return (
        records.where(F.col("text").rlike("[^\\x00-\\x7F]"))
        .select("source", F.explode(F.split("text", TOKEN_BREAK)).alias("token"))
        .where(F.col("token").rlike("[^\\x00-\\x7F]"))
        .groupBy("source", "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


class Decoder:
    """What the EM learned: the bigram sketch and the sieve of suspect tokens (both of fixed size), the weights of the
    ciphers over all sources (one number each) and by source (a DataFrame)."""

    def __init__(self, two: np.ndarray, one: np.ndarray, sieve: np.ndarray, everywhere: dict[int, float], sources: DataFrame):
        self.two, self.one, self.sieve, self.everywhere, self.sources = two.astype(np.float32), one.astype(np.float32), sieve, everywhere, sources


def _slot(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % SIEVE


def sieve_of(tokens: DataFrame) -> np.ndarray:
    """Which slots of the sieve the tokens (token) fall in."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"slot": np.unique([_slot(t) for t in b["token"]]), "n": 1})

    return _gathered(tokens.select("token").mapInPandas(part, "slot long, n long"), SIEVE, np.bool_)


def fit(records: DataFrame, rounds: int = 2) -> Decoder:
    """Learn the ciphers of every source. records: source, text.

    Tokens are judged once for the whole corpus in each round; sources enter where the judgements are weighed.
    """
    spark = records.sparkSession
    width = max(spark.sparkContext.defaultParallelism * 3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_source = cut(token_counts(records))
    tokens = cut(by_source.groupBy("token").agg(F.sum("n").alias("n")).repartition(width, "token"))
    two, one = count_bigrams(tokens, "token", read=_start)
    won, everywhere = None, dict(_FIRST)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((two, one, everywhere))

        def part(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            lm, weights = Bigrams(*held.value[:2]), held.value[2]
            for b in batches:
                got = [_best(t, lm, weights) for t in b["token"]]
                yield pd.DataFrame({"token": b["token"], "n": b["n"], "reading": [x[0] for x in got], "pair": [x[1] for x in got], "lead": [x[2] for x in got], "suspect": [x[3] for x in got]})

        won = cut(tokens.mapInPandas(part, "token string, n long, reading string, pair int, lead double, suspect boolean"))
        two, one = count_bigrams(won)
        held_by = dict(won.groupBy("pair").agg(F.sum("n")).collect())  # one row for each cipher
        everywhere = {k: n / sum(held_by.values()) for k, n in held_by.items() if k >= 0}

    sieve = sieve_of(won.where("suspect"))
    garbled_by = by_source.hint("merge").join(won.where("pair >= 0").select("token", "pair", "lead"), "token").groupBy("source", "pair").agg(F.sum(F.col("n") / (1 + F.exp(-F.col("lead")))).alias("w"))
    weights = garbled_by.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("pair", "w"))).alias("w"))  # at most one entry for each cipher
    sizes = by_source.groupBy("source").agg(F.sum("n").alias("all"))
    return Decoder(two, one, sieve, everywhere, cut(weights.join(sizes, "source")))


def restored(records: DataFrame, decoder: Decoder) -> DataFrame:
    """records (rec_table, rec_key, source, text) that are garbled, with `restored` text (null where bytes are lost) and `cipher`."""
    spark = records.sparkSession
    held = spark.sparkContext.broadcast((decoder.two, decoder.one, decoder.everywhere, decoder.sieve))

    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sieve = held.value[3]
        for b in batches:
            yield b[[ "\ufffd" in t or any(_HIGH.search(x) and sieve[_slot(x)] for x in _TOKEN.findall(t)) for t in b["text"]]]

    suspect = records.where(F.col("text").rlike("[^\\x00-\\x7F]")).select("rec_table", "rec_key", "source", "text").mapInPandas(sift, "rec_table string, rec_key string, source string, text string")
    salted = suspect.withColumn("salt", F.pmod(F.xxhash64("rec_key"), F.lit(SALTS)).cast("int"))
    weights = decoder.sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Sources grow with the corpus, and a scan's estimate knows neither the files' compression nor the copies: no broadcast.
    both = salted.hint("merge").join(weights, ["source", "salt"], "left").select("rec_table", "rec_key", "text", "all", F.map_entries("w").alias("w"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm, everywhere, sieve = Bigrams(*held.value[:2]), held.value[2], held.value[3]
        known = functools.lru_cache(10_000)(lambda t: judged(t, lm))
        for b in batches:
            rows = []
            for table, key, text, n, w in zip(b["rec_table"], b["rec_key"], b["text"], b["all"], b["w"]):
                own = {x["key"]: x["value"] for x in w} if w is not None else {}
                n = 0.0 if n is None or n != n else n
                weights = {k: (own.get(k, 0.0) + STRENGTH * everywhere.get(k, 0.0)) / (n + STRENGTH) for k in {*own, *everywhere}}
                lost = "\ufffd" in text
                pairs: dict[int, int] = {}

                def swap(m: re.Match) -> str:
                    t = m[0]
                    if not _HIGH.search(t) or not sieve[_slot(t)]:
                        return t
                    plain, got = known(t)
                    lead, k, d = max(((score - plain + math.log(max(weights.get(k, 0.0), _FIRST.get(k, FLOOR))), k, d) for k, d, score in got), default=(0.0, -1, t))
                    if lead <= MARGIN:
                        return t
                    pairs[k] = pairs.get(k, 0) + 1
                    return d

                out = _TOKEN.sub(swap, text)
                if pairs or lost:
                    k = max(pairs, key=lambda x: (pairs[x], -x)) if pairs else None
                    rows.append((table, key, None if lost else out, "lost" if k is None else "{}<-{}".format(*PAIRS[k])))
            yield pd.DataFrame(rows, columns=["rec_table", "rec_key", "restored", "cipher"])

    width = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return both.repartition(width, "rec_key").mapInPandas(part, "rec_table string, rec_key string, restored string, cipher string").dropDuplicates(["rec_table", "rec_key"])


def records_of(chunks: DataFrame, conv_results: DataFrame) -> DataFrame:
    """Both text columns as (rec_table, rec_key, source, text); nulls dropped."""
    a = chunks.select(F.lit("chunks").alias("rec_table"), F.col("id").alias("rec_key"), F.col("doc").alias("source"), F.col("text").alias("text"))
    b = conv_results.select(F.lit("conv_results").alias("rec_table"), F.col("conv_id").cast("string").alias("rec_key"), F.concat(F.lit("conv:"), F.coalesce("project", F.lit(""))).alias("source"), F.col("method").alias("text"))
    return a.unionByName(b).where("text is not null and rec_key is not null").withColumn("source", F.coalesce("source", F.lit("")))


def garbled(chunks: DataFrame, conv_results: DataFrame) -> DataFrame:
    """Garbled records with their restored text."""
    records = records_of(chunks, conv_results)
    return restored(records, fit(records))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p2_found: the garbled records' keys."""
    return garbled(*_inputs(spark, folder)).select("rec_table", "rec_key")


def repaired(spark: SparkSession, folder: str) -> DataFrame:
    """p2_restored: the garbled records with what could be restored, and the cipher that most of their tokens were under."""
    return garbled(*_inputs(spark, folder))


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "chunks", "id", "doc", "text"), table(spark, folder, "conv_results", "conv_id", "project", "method")


QUERIES = {"p2_found": found, "p2_restored": repaired}
SQL: dict[str, str] = {}

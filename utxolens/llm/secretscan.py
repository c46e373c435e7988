"""Secret scans: fixed patterns, and guess costs of credential values.

Patterns give spans of kind ``assign`` (a credential name with a value),
``access`` (access key ids) and ``hex`` (long hexadecimal runs). The method
adds kind ``guess``: a value in a credential context whose cheapest guess is
costly. The cost of a value is the least sum, over all ways to cut it into
parts, of the base-10 logarithm of the guesses each part takes: common words
(also capitalised or with look-alike digits), dates, repeated blocks, walks
along keyboard rows, alphabet or digits, and brute force for the rest. One pass
over the value finds the least sum at every place (dynamic programming).
Brute force of a character takes as many guesses as the classes of characters
in the value have members (``prices``), so six mixed characters can be a secret;
letters that look like a word, and the joiners of names, paths and numbers, take
ten.

Common words are a short fixed list of usual parts of passwords, and the
corpus's own: ``corpus_words`` counts the words of all texts, values in a
credential context left out, and ranks those that stand ``OFTEN`` times or more
(the ``MOST`` most frequent at most, so the list has a bound and is broadcast).

Texts are scanned whole, a row at a time inside Arrow batches; only word counts
are shuffled, added up by each task first. Positions are code points, ends
exclusive.

Edge cases: a null text is empty and has no spans; repeated rows are scanned
each; an empty table stays empty; other columns stay, one named like an added
column is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import inf, log10

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .bpe import hot_words
from .common import arrow_rows, materialize, small_batches, spare, text_or_empty

KINDS = ("assign", "access", "hex", "guess")
COST = 10.0               # least log10 of guesses of a value that counts as a secret
MARK = "[SECRET]"
OFTEN = 50                # times a word of the corpus has to stand to count as common
MOST = 50_000             # most common words of the corpus
LONGEST = 20              # letters of a common word, at most
FLUSH = 300_000           # distinct words a task adds up before it hands them on

# fixed values: the base patterns, with the least lengths checked after the match
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")      # whole runs of 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|auth|private|secret)[_-]?key|auth|credentials?|login|bearer)["']?[ \t]*(?:[:=]|=>)[ \t]*["'`]?([^\s"'`,;<>]{6,})""",
    re.I | re.A)
_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "login", "bearer")

#: common parts of chosen passwords, most frequent first
WORDS = ("password pass admin love qwerty welcome monkey dragon letmein master login princess "
         "football baseball sunshine shadow superman iloveyou michael computer secret summer "
         "winter spring autumn test user root guest default changeme example temp hello world "
         "the and for you that with this from have are not but all can one out day get has him "
         "how man new now old see two way who boy did its let put say she too use token key api "
         "your my our name mail email server data base web site home work office school company "
         "service system access private public demo sample secure strong random blue red green "
         "black white orange yellow purple cat dog bird fish horse tiger lion bear star moon sun "
         "sky sea fire water earth wind king queen money game play music happy angel baby girl "
         "friend family john david james robert daniel thomas george charlie jordan killer "
         "trustno cheese coffee banana apple london paris berlin null none true false value "
         "string number here there insert replace placeholder dummy").split()
#: longest overlap of a run's ends with other parts (words and dates are shorter)
EDGE = 16
_ALIKE = str.maketrans("01345789@$!", "oleastbgasi")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./",
         "abcdefghijklmnopqrstuvwxyz", "0123456789")
_DATE = re.compile(r"(?:(\d{4})([-/._]?)(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/._]?)(\d{1,2})\6(\d{4}|\d{2}))")
_YEAR = re.compile(r"(?:19|20)\d\d")
_JOINERS = "._-:/@"
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOWEL = re.compile(r"[aeiouy]", re.I)
_LETTERS = re.compile(rf"(?<![a-z])[a-z]{{3,{LONGEST}}}(?![a-z])")
_CLASSES = ((re.compile(r"[a-z]"), 26), (re.compile(r"[A-Z]"), 26), (re.compile(r"[0-9]"), 10),
            (re.compile(rf"[^A-Za-z0-9{re.escape(_JOINERS)}]"), 33))


@lru_cache(maxsize=1)
def _ranks() -> dict[str, int]:
    return {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}


def corpus_words(docs: DataFrame, text: str = "text", often: int = OFTEN, most: int = MOST) -> list[str]:
    """The corpus's words of 3 to ``LONGEST`` letters a-z that stand ``often``
    times or more outside of credential values, most frequent first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()),
                                               pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        for b in batches:
            for t in b.column(0):
                t = t.as_py()
                if any(x in t.lower() for x in _HINTS):
                    t = CONTEXT.sub(" ", t)
                seen.update(_LETTERS.findall(t.lower()))
                if len(seen) >= FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    spark = docs.sparkSession
    with arrow_rows(spark):
        words = materialize(spark, docs.select(text_or_empty(text).alias("t")).mapInArrow(
            count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= often), "corpus_words")
    rows = hot_words(words, most, LONGEST).select("word", "n").collect()       # at most ``most``
    return [r.word for r in sorted(rows, key=lambda r: (-r.n, r.word))]


def ranks_of(words: list[str]) -> dict[str, int]:
    """Ranks of the fixed list and of further words: the better one of both."""
    out = dict(_ranks())
    for i, w in enumerate(words):
        out[w] = min(out.get(w, i + 1), i + 1)
    return out


@lru_cache(maxsize=1)
def _next() -> frozenset[str]:
    """Pairs of neighbouring keys, letters or digits, in both directions."""
    pairs = {r[i:i + 2] for r in _ROWS for i in range(len(r) - 1)}
    return frozenset(pairs | {p[::-1] for p in pairs})


def _runs(same: list[bool], reach: int):
    """(start, end) of every longest stretch of places that go on alike."""
    a = None
    for p, x in enumerate([*same, False]):
        if x and a is None:
            a = p
        elif not x and a is not None:
            yield a, p + reach
            a = None


def _inside(a: int, b: int):
    """(start, end) of the parts of a run that a cheapest cut can use. A run costs
    less than its pieces, so a long one is only cut where a word or date, or
    another run, overlaps its ends; those overlaps are at most ``EDGE`` long."""
    places = range(a, b + 1) if b - a <= 2 * EDGE else [
        *range(a, a + EDGE + 1), *range(b - EDGE, b + 1)]
    for x, i in enumerate(places):
        for j in places[x + 1:]:
            if j - i >= 3:
                yield i, j


def _parts(v: str, ranks: dict[str, int] | None = None):
    """(start, end, cost) of every part of the value that is cheap to guess; the
    parts grow with the value's length, also where one run fills it."""
    low, alike, n = v.lower(), v.lower().translate(_ALIKE), len(v)
    ranks, near = _ranks() if ranks is None else ranks, _next()
    longest = LONGEST
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            for s, more in ((low[i:j], 0.0), (alike[i:j], log10(2))):
                if s in ranks:
                    changed = log10(2) if v[i:j] != low[i:j] else 0.0
                    yield i, j, log10(ranks[s] + 1) + changed + more
                    break
        m = _YEAR.match(v, i)
        if m:
            yield i, m.end(), log10(120)
        m = _DATE.match(v, i)
        if m:
            a, b = (m[3], m[4]) if m[1] else (m[5], m[7])
            if 1 <= min(int(a), int(b)) <= 12 and 1 <= max(int(a), int(b)) <= 31:
                yield i, m.end(), log10(365 * 120) + (log10(4) if m[2] or m[6] else 0.0)
    for size in range(1, 5):                           # repeated blocks
        for a, b in _runs([v[p] == v[p + size] for p in range(n - size)], size):
            for i, j in _inside(a, b):
                if (j - i) % size == 0 and j - i > size:
                    yield i, j, size + log10((j - i) // size)
    for a, b in _runs([low[p:p + 2] in near for p in range(n - 1)], 1):      # walks
        for i, j in _inside(a, b):
            yield i, j, log10(50) + log10(j - i)


def prices(value: str) -> list[float]:
    """log10 of the guesses that brute force takes for each character: the size
    of the value's classes together; ten guesses for a joiner and for a letter of
    a piece of three or more that has a vowel and the case of a word."""
    size = sum(n for c, n in _CLASSES if c.search(value))
    out = [1.0 if c in _JOINERS else max(1.0, log10(max(size, 1))) for c in value]
    for m in _PIECE.finditer(value):
        if m.end() - m.start() >= 3 and _VOWEL.search(m[0]):
            out[m.start():m.end()] = [1.0] * (m.end() - m.start())
    return out


def guess_cost(value: str, each: list[float] | None = None, ranks: dict[str, int] | None = None) -> float:
    """Least log10 of guesses over all segmentations of the value; ``each`` has
    brute force's price of every character, 1 if not given, and ``ranks`` those
    of common words, the fixed list's if not given."""
    n = len(value)
    each = [1.0] * n if each is None else each
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, c in _parts(value, ranks):
        ending[j].append((i, c))
    best = [0.0] + [inf] * n
    for j in range(1, n + 1):
        best[j] = best[j - 1] + each[j - 1]            # brute force
        for i, c in ending[j]:
            best[j] = min(best[j], best[i] + c)
    return best[n]


def find(text: str, cost: float = COST, ranks: dict[str, int] | None = None
         ) -> list[tuple[int, int, int, int, float | None]]:
    """(start, kind number, end, start of the value, cost) of every span, sorted."""
    out: list[tuple[int, int, int, int, float | None]] = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        out += [(m.start(), 0, m.end(), m.start(2), None) for m in ASSIGN.finditer(text)
                if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), None) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start(), None) for m in HEX.finditer(text)]
    if any(x in low for x in _HINTS):
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".)]}!?#*$%&|")
            c = guess_cost(value, prices(value), ranks) if len(value) >= 6 else 0.0
            if c >= cost:
                s = m.start(1)
                out.append((s, 3, s + len(value), s, c))
    return sorted(out, key=lambda x: x[:3])


_SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("value_start", T.IntegerType()),
    T.StructField("cost", T.DoubleType())]))
_ARROW_SPAN = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
    ("value_start", pa.int32()), ("cost", pa.float64())]))


def spans(text: str, cost: float = COST, ranks=None) -> Column:
    """Column of a text's spans, by start, then kind as listed; ``ranks`` is a
    broadcast of words' ranks."""
    @arrow_udf(_SPAN)
    def scan(texts: pa.Array) -> pa.Array:
        known = None if ranks is None else ranks.value
        return pa.array([[(KINDS[k], s, e, v, c) for s, k, e, v, c in find(t, cost, known)]
                         for t in texts.to_pylist()], _ARROW_SPAN)
    return scan(text_or_empty(text))


@arrow_udf(T.StringType())
def _cut(texts: pa.Array, found: pa.Array) -> pa.Array:
    out = []
    for t, f in zip(texts.to_pylist(), found.to_pylist()):
        at, parts = 0, []
        for s, e in sorted((x["value_start"], x["end"]) for x in f):
            if s >= at:
                parts += [t[at:s], MARK]
            at = max(at, e)
        out.append("".join([*parts, t[at:]]) if f else t)
    return pa.array(out, pa.string())


def find_secrets(docs: DataFrame, *, text: str = "text", out: str = "spans",
                 cost: float = COST) -> DataFrame:
    """The documents with their spans; common words are the fixed list's and
    those of ``docs`` themselves."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(ranks_of(corpus_words(docs, text)))
    small_batches(spark)
    return docs.withColumn(out, spans(text, cost, ranks))


def redact(docs: DataFrame, *, text: str = "text", cost: float = COST) -> DataFrame:
    """The documents with every secret value replaced by ``MARK``; null texts
    stay null and texts without a span are unchanged."""
    own = spare(docs, "_spans")
    found = find_secrets(docs, text=text, out=own, cost=cost)
    return found.withColumn(text, F.when(F.size(own) == 0, F.col(text)).otherwise(
        _cut(text_or_empty(text), F.col(own)))).drop(own)

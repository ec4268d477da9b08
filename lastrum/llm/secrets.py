"""Secret scans: fixed patterns, and the guess cost of values in a credential context.

The cost of a value is the least sum, over all its segmentations, of the log10 of the guesses for each part: a common word by
its rank, a date or year, a repeat of any part of what stands before, a walk on the keyboard or along the alphabet from any
place, or brute force character by character. Common words are a fixed list and the words that most documents hold outside of such values, ranked by their
documents: at most VOCABULARY words of 3 to 40 letters, in LEAST_DOCS documents or more. Values that cost at least LEAST_COST are reported as guess spans; "password123" is not, a random string is.

Offsets are code points, ends exclusive. Defined results: null and empty texts have no spans. Values of any length are
costed whole, in time and memory linear in their length. Repeated rows give repeated results; a null doc_id is passed on. Empty tables
give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastrum.llm.words import slices

KINDS = ("assign", "access", "hex", "guess")
LEAST_COST = 8.0
#: Most words taken from the documents, and the fewest documents that hold one.
VOCABULARY, LEAST_DOCS = 50_000, 3
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: A character costs 2 at most (_brute), so a value of fewer than 4 stays below LEAST_COST.
_CONTEXT = re.compile(r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|access_?key|private_?key|credential|auth)[\"']?\s*(?:[:=]|=>|:=)\s*(?:\"([^\"\n]{4,})\"|'([^'\n]{4,})'|([^\s\"'<>,;]{4,}))", re.I | re.A)
#: One of these is in each lower-cased text that has a context.
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth")

# Common password words, most common first.
WORDS = """password admin welcome login master dragon monkey letmein shadow sunshine princess football baseball iloveyou trustno
secret superman batman test guest user root changeme default example sample demo hello freedom whatever michael jordan
summer winter spring autumn monday friday january love money secure server system network internet company office""".split()
# Rows of a keyboard, and the runs people type.
RUNS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujmikolp")
_NEXT = {(a, b) for run in RUNS for a, b in zip(run, run[1:])} | {(b, a) for run in RUNS for a, b in zip(run, run[1:])}
_LEET = str.maketrans("013457@$!", "oieastasi")
_PROSE = re.compile(r"\b[^\W\d_]{3,40}\b")
_YEAR, _MONTH, _DAY, _SEP = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", "[-/._]?"
#: Several may begin at one place, and each is a part of its own.
_DATES = tuple(re.compile(x, re.A) for x in (_YEAR + _SEP + _MONTH + _SEP + _DAY, _DAY + _SEP + _MONTH + _SEP + _YEAR, _YEAR))
#: log10 of guesses: a date of 150 years, a year, the start of a walk, each of its steps, and the choice of another part.
DATE_COST, YEAR_COST, WALK_COST, STEP_COST, PART_COST = log10(365 * 150), log10(150), log10(40), log10(1.2), log10(2)


def _brute(c: str) -> float:
    return log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


class Suffixes:
    """A suffix automaton that grows by a character at a time: push() gives the length of the longest suffix that stands before, too."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def push(self, c: str) -> int:
        new, at = len(self.next), self.last
        self.next.append({})
        self.length.append(self.length[at] + 1)
        self.link.append(0)
        while at >= 0 and c not in self.next[at]:
            self.next[at][c] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][c]
            if self.length[to] != self.length[at] + 1:
                copy = len(self.next)
                self.next.append(dict(self.next[to]))
                self.length.append(self.length[at] + 1)
                self.link.append(self.link[to])
                while at >= 0 and self.next[at].get(c) == to:
                    self.next[at][c] = copy
                    at = self.link[at]
                self.link[to] = to = copy
            self.link[new] = to
        self.last = new
        return self.length[self.link[new]]


def word_cost(part: str, low: str, plain: str, rank: int) -> float:
    """Of a common word by its rank: low and plain are the part in lower case, without and with digits read as letters."""
    shifted = 0 if part == low else 0.3 if part.istitle() or part.isupper() else 0.3 * len(part)
    return PART_COST + log10(rank + 1) + shifted + (0.3 if plain != low else 0)


def repeat_cost(end: int) -> float:
    """Of a part that stands before, too: the choice of where, among the places up to its end."""
    return PART_COST + log10(end)


def coster(words: Iterable[str] = ()) -> Callable[..., float]:
    """guess_cost(value, enough): log10 of the guesses for the cheapest segmentation of the value; words, most common first, join
    WORDS. Once no segmentation can cost less than enough, a number of at least enough is returned in its place."""
    ranks = {w: i + 1 for i, w in enumerate(words)}
    ranks |= {w: min(i + 1, ranks.get(w, i + 1)) for i, w in enumerate(WORDS)}
    longest = max(map(len, ranks))

    def guess_cost(value: str, enough: float = float("inf")) -> float:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        plain = low.translate(_LEET)
        n, never = len(value), float("inf")
        best = [0.0] + [never] * n
        before, window = Suffixes(), deque()  # places from which a repeat may reach the current one, cheapest first
        walk = never  # the cheapest ending in a walk of 3 or more whose last character is the one before
        run = 1  # characters of the unbroken walk that ends here
        for j in range(1, n + 1):
            i = j - 1
            # parts that begin at i: all costs of best[i] are known by now
            for form in _DATES if value[i].isdigit() else ():
                if date := form.match(value, i):
                    best[date.end()] = min(best[date.end()], best[i] + PART_COST + (YEAR_COST if date.end() - i == 4 else DATE_COST))
            for k in range(i + 3, min(n, i + longest) + 1):
                rank = ranks.get(plain[i:k])
                if rank:
                    best[k] = min(best[k], best[i] + word_cost(value[i:k], low[i:k], plain[i:k], rank))
            # parts that end at j
            run = run + 1 if i and (low[i - 1], low[i]) in _NEXT else 1
            walk = walk + STEP_COST if run > 1 else never
            if run >= 3:
                walk = min(walk, best[j - 3] + PART_COST + WALK_COST + 3 * STEP_COST)
                best[j] = min(best[j], walk)
            while window and best[window[-1]] >= best[i]:
                window.pop()
            window.append(i)
            far = before.push(low[i])
            while window and window[0] < j - far:
                window.popleft()
            if window:
                best[j] = min(best[j], best[window[0]] + repeat_cost(j))
            best[j] = min(best[j], best[i] + _brute(value[i]))
            # the last boundary up to j of any segmentation, with the part that begins there: a word or date is already counted in
            # the place where it ends, a walk either runs or begins at one of the two places before, a repeat stands in the window
            ahead = min(best[j : j + max(longest, 10) + 1])
            repeat = best[window[0]] + repeat_cost(j) if window else never
            if j > 2 and min(ahead, walk, best[j - 1], best[j - 2], repeat) >= enough:
                return enough
        return best[n]

    cached = lru_cache(maxsize=4096)(guess_cost)
    return lambda value, enough=float("inf"): (cached if len(value) <= 200 else guess_cost)(value, enough)


guess_cost = coster()


def prose(text: str) -> set[str]:
    """The distinct lower-cased words of a text, without those in credential values."""
    low = text.lower()
    if any(h in low for h in _HINTS):
        low = _ASSIGN.sub(" ", _CONTEXT.sub(" ", low))
    return set(_PROSE.findall(low))


def vocabulary(docs: DataFrame, size: int = VOCABULARY, least_docs: int = LEAST_DOCS) -> list[str]:
    """The words that most documents hold, most common first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                counts.update(prose(text or ""))
            if len(counts) >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    words = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs)
    return [r["word"] for r in words.orderBy(F.desc("n"), "word").limit(size).collect()]


def spans(text: str, least_cost: float = LEAST_COST, cost: Callable[[str], float] = guess_cost) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all secrets, by start, then kind."""
    low = text.lower()
    found = []
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
        found += [(m.start(m.lastindex), 3, m.end(m.lastindex)) for m in _CONTEXT.finditer(text) if cost(m[m.lastindex], least_cost) >= least_cost]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def scan(docs: DataFrame, least_cost: float = LEAST_COST) -> DataFrame:
    """One row per document: doc_id, found (array of kind, start, end, by start, then kind)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = coster(shared.value)
        for batch in slices(batches):
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(text or "", least_cost, cost)] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, found array<struct<kind:string,start:bigint,end:bigint>>")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess."""
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = joined(F.filter("found", lambda s: s["kind"] != "guess"))
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), joined("found").alias("spans"), count("guess"))


def digest_of(text: str) -> str:
    """base_sha256 of one text, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans(text) if k < 3).encode()).hexdigest()

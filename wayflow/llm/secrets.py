"""Secret scan: fixed patterns, and guess costs of values in a credential context.

A value that stands where a credential would (``db_pwd: ...``, ``Bearer ...``) is segmented at minimum cost into words,
dates, repeats, keyboard walks, sequences and brute-force characters.  The cost is the decimal logarithm of the guesses
needed; values that cost ``min_cost`` or more are reported as further spans of kind ``guess``.  Words are ranked: a short list
of common parts of passwords, then the most frequent words of the corpus itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, buffers, id_text, read, slices, spaced, tidied

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same runs as [0-9a-f]+ of 24 or more
KINDS = ("assign", "access", "hex", "guess")
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "login", "credential", "bearer", "pin")
_NAME = r"(?:password|passwd|passphrase|passcode|secret|token|(?:api|private|secret|access)[_-]?key|(?<![A-Za-z])(?:pass|pwd|auth|authorization|login|credentials?|pin))"
#: A longer name that may hold one (DB_PASSWORD_PROD) with a sign or "is" after it; or the scheme that stands before a bearer's value.
CONTEXT = re.compile(r"""(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]++)["']?[\x20\t]*+(?:=>|[:=]|\bis\b)|\bbearer[\x20\t]++""", re.I | re.A)
NAME = re.compile(rf"{_NAME}(?=[_.-]|$)", re.I | re.A)
#: A separator that another one or the end follows: what stands before it is no name of what comes after.
BROKEN = re.compile(r"[_.-](?=[_.-]|$)")
SCHEME = re.compile(r"""[\x20\t]*+["']?(?:(?:bearer|basic)[\x20\t]++)?""", re.I | re.A)
VALUE = re.compile(r"""[^\s"'<>,;]{6,}""", re.A)
# Common parts of passwords, most likely first; a parameter of the operator.
WORDS = ("password", "love", "admin", "letmein", "welcome", "monkey", "dragon", "master", "login", "princess", "sunshine", "shadow", "football", "baseball", "summer", "winter", "spring", "autumn", "hello", "secret", "token", "access", "root", "test", "user", "guest", "pass", "changeme", "default", "system", "server", "qwerty", "iloveyou", "trustno", "superman", "batman", "freedom", "whatever", "michael", "jordan", "hunter", "ranger", "soccer", "hockey", "killer", "george", "charlie", "andrew", "michelle", "jessica", "pepper", "daniel", "access", "joshua", "maggie", "starwars", "silver", "william", "dallas", "yankees", "example", "sample", "your", "here", "my", "the", "new", "old")
LEET = str.maketrans("@4310$57!", "aaelosstl")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")

def _next_to() -> frozenset[tuple[str, str]]:
    """Neighbours on the keyboard: in a row, and the keys below, which are shifted by half a key."""
    out = set()
    for r, row in enumerate(ROWS):
        for k, key in enumerate(row):
            near = [row[k + 1 : k + 2]]
            if r + 1 < len(ROWS):
                below = ROWS[r + 1]
                near += [below[j : j + 1] for j in ((k - 1, k) if r == 0 else (k, k - 1)) if j >= 0]
            out |= {(key, x) for x in near if x} | {(x, key) for x in near if x}
    return frozenset(out)


NEAR = _next_to()


def lower(value: str) -> str:
    """Lower case, character by character, so that positions stay."""
    return "".join(x if len(x := c.lower()) == 1 else c for c in value)


def brute_cost(c: str) -> float:
    """A brute-force character: an alphabet's size, as an attacker would mix them."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isascii() and c.isalpha() else math.log10(33)


def word_cost(part: str, rank: int) -> float:
    """A word by its rank, and how it is spelled: substituted signs (part differs from the word), one capital, all capitals, or mixed."""
    low = lower(part)
    case = 0.0 if part == low else math.log10(2) if lower(part[1:]) == part[1:] or part == part.upper() else math.log10(2) * min(len(part), 8)
    return math.log10(rank + 2) + (0.0 if low.isalpha() else math.log10(4)) + case


def run_cost(kind: str, size: int) -> float:
    return (3.0 + 0.15 * size if kind == "walk" else 1.6) + math.log10(size)


def date_cost(part: str) -> float:
    return math.log10(120) if len(part) == 4 else math.log10(365 * 120 * (4 if not part.isdigit() else 1))


def walks(a: str, b: str) -> bool:
    return (a, b) in NEAR


def follows(a: str, b: str) -> bool:
    return abs(ord(a) - ord(b)) == 1 and a.isalnum() and b.isalnum()


DATES = tuple(re.compile(x) for x in (
    r"(?:19|20)\d\d", r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d",
))


class Cheapest:
    """The least base + price(end - start) over the starts pushed so far, for ends that grow; ``price`` is concave.

    Of two starts the older one gains on the newer, so starts are a stack: the top is cheapest, and each is overtaken by the one
    below at a known end.  Starts that would never be cheapest are not kept, so a push or a question takes a logarithm of time.
    """

    def __init__(self, price: Callable[[int], float], last: int):
        self.price, self.last = price, last
        self.stack: list[tuple[float, int]] = []
        self.until: list[int] = []

    def push(self, base: float, start: int, now: int) -> None:
        """A start that counts for ends from ``now`` on; starts come in order."""
        cost = lambda at, end: at[0] + self.price(end - at[1])
        new, cross = (base, start), self.last + 1
        while self.stack:
            top = self.stack[-1]
            if cost(top, now) <= cost(new, now):
                return
            low, cross = now, self.last + 1  # the first end at which the top has overtaken the new start
            while cross - low > 1:
                middle = (low + cross) // 2
                if cost(top, middle) <= cost(new, middle):
                    cross = middle
                else:
                    low = middle
            if cross < self.until[-1]:
                break
            self.stack.pop()
            self.until.pop()
            cross = self.last + 1
        self.stack.append(new)
        self.until.append(cross)

    def least(self, end: int) -> tuple[float, int]:
        while len(self.stack) > 1 and self.until[-1] <= end:
            self.stack.pop()
            self.until.pop()
        base, start = self.stack[-1]
        return base + self.price(end - start), start


def repeats(value: str) -> list[tuple[int, int, int]]:
    """(p, a, z): the maximal stretches value[a:z] of shortest period p that hold two units or more, by growing p.

    A stretch holds a multiple of p at which value[k] == value[k + p], so only these are looked at, and not where a shorter period that
    divides p goes on.
    """
    n = len(value)
    code = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = code.tolist()
    out: list[tuple[int, int, int]] = []
    longer: list[tuple[int, int, int]] = []
    for p in range(1, n // 2 + 1):
        longer = [r for r in longer if r[2] - r[1] >= 2 * p]
        at = np.arange(0, n - p, p)
        at = at[code[at] == code[at + p]]
        for q, a, z in longer:
            if p % q == 0 and len(at):
                at = at[(at < a) | (at >= z - p)]
        end = 0
        for k in at.tolist():
            if k < end:
                continue
            a = k
            while a and k - a < 32 and chars[a - 1] == chars[a - 1 + p]:
                a -= 1
            if k - a == 32:
                a -= _same(code[:a][::-1], code[p : p + a][::-1])
            end = k + 1
            while end < n - p and end - k < 32 and chars[end] == chars[end + p]:
                end += 1
            if end - k == 32:
                end += _same(code[end : n - p], code[end + p :])
            if end - a >= p:
                out.append((p, a, end + p))
                longer.append(out[-1])
    return out


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements are the same before the first that differ."""
    k, size = 0, 64
    while k < len(a):
        odd = a[k : k + size] != b[k : k + size]
        if odd.any():
            return k + int(odd.argmax())
        k, size = k + size, size * 2
    return len(a)


class Guesser:
    """Minimum-cost segmentation with one ranked list of words.

    Offered are every occurrence of a word (also with substituted signs), every date, every part of a walk or sequence of 3 keys or more, and two
    or more of a unit that is no repeat itself, wherever they start and however long they are; a unit's price is its own least cost.  Prices
    of runs are concave in their length, so the best start of a run is kept instead of tried, and a unit is priced only where
    even a lower bound of its cost would pay: time is nearly linear in a value's length.
    """

    def __init__(self, words: tuple[str, ...] | list[str] = WORDS):
        self.ranks: dict[str, int] = {}
        for w in words:
            if w:
                self.ranks.setdefault(w, len(self.ranks))
        self.finder = ahocorasick.Automaton()
        for w, rank in self.ranks.items():
            self.finder.add_word(w, (len(w), rank))
        self.finder.make_automaton()
        self._known: dict[str, tuple[float, list[tuple[str, str]]]] = {}

    def fixed(self, value: str) -> dict[int, list[tuple[int, float, str]]]:
        """Words and dates by their end: start, cost, kind."""
        low, out = lower(value), {}
        for text in {low, low.translate(LEET)} if self.ranks else ():
            for last, (size, rank) in self.finder.iter(text):
                z = last + 1
                out.setdefault(z, []).append((z - size, word_cost(value[z - size : z], rank), "word"))
        if any(c.isdigit() for c in value):
            for k in range(len(value) - 3):
                if value[k].isdigit():
                    for form in DATES:
                        if m := form.match(value, k):
                            out.setdefault(m.end(), []).append((k, date_cost(m[0]), "date"))
        return out

    def cost(self, value: str) -> tuple[float, list[tuple[str, str]]]:
        """log10 of the guesses of the cheapest segmentation, and its (kind, part) list.  The empty value costs 0."""
        got = self._known.get(value)
        if got is None:
            if len(self._known) >= 1 << 14:
                self._known.clear()
            got = self._segmented(value)
            if len(value) <= 256:
                self._known[value] = got
        return got

    def _segmented(self, value: str) -> tuple[float, list[tuple[str, str]]]:
        low, n = lower(value), len(value)
        begin: dict[int, list[_Run | _Repeat]] = {}
        for kind, linked in (("walk", walks), ("sequence", follows)):
            start = 0
            for k in range(1, n + 1):
                if k == n or not linked(low[k - 1], low[k]):
                    if k - start >= 3:
                        begin.setdefault(start + 3, []).append(_Run(kind, start, k))
                    start = k
        for p, a, z in repeats(value):
            begin.setdefault(a + 2 * p, []).append(_Repeat(self, value, p, a, z))
        fixed = self.fixed(value)
        best, origin = [0.0] * (n + 1), [(0, "")] * (n + 1)
        active: list[_Run | _Repeat] = []
        for k in range(1, n + 1):
            least, here = best[k - 1] + brute_cost(value[k - 1]), (k - 1, "brute")
            for a, cost, kind in fixed.get(k, ()):
                if best[a] + cost < least:
                    least, here = best[a] + cost, (a, kind)
            if k in begin or active:
                active = [r for r in active if r.z >= k] + begin.pop(k, [])
                for run in active:
                    cost, a = run.best(k, best, least)
                    if cost < least:
                        least, here = cost, (a, run.kind)
            best[k], origin[k] = least, here
        parts: list[tuple[str, str]] = []
        k = n
        while k:
            a, kind = origin[k]
            if kind == "brute" and parts and parts[-1][0] == "brute":
                parts[-1] = (kind, value[a:k] + parts[-1][1])
            else:
                parts.append((kind, value[a:k]))
            k = a
        return best[n], parts[::-1]


class _Run:
    """A walk or sequence value[a:z]: any three or more of its characters."""

    def __init__(self, kind: str, a: int, z: int):
        self.kind, self.a, self.z = kind, a, z
        self.starts = Cheapest(lambda size: run_cost(kind, size), z)

    def best(self, k: int, best: list[float], _: float) -> tuple[float, int]:
        self.starts.push(best[k - 3], k - 3, k)
        return self.starts.least(k)


class _Repeat:
    """A stretch value[a:z] of shortest period p.  Starts a multiple of p apart have one unit.

    Until a unit is priced, best[start + p] stands for the cost up to its end: it is no more than that.
    """

    kind = "repeat"

    def __init__(self, guesser: Guesser, value: str, p: int, a: int, z: int):
        self.guesser, self.value, self.p, self.a, self.z = guesser, value, p, a, z
        self.starts: dict[int, Cheapest] = {}
        self.unit: dict[int, float] = {}

    def best(self, k: int, best: list[float], least: float) -> tuple[float, int]:
        index, rest = divmod(k - self.a, self.p)
        at = lambda i: self.a + rest + i * self.p
        new = lambda: self.starts.setdefault(rest, Cheapest(math.log10, (self.z - self.a - rest) // self.p))
        base = lambda i: best[at(i)] + self.unit[rest] if rest in self.unit else best[at(i + 1)]
        starts = self.starts.get(rest) or new()
        starts.push(base(index - 2), index - 2, index)
        cost, i = starts.least(index)
        if rest not in self.unit and cost < least - 1e-9:
            self.unit[rest] = self.guesser.cost(self.value[at(i) : at(i + 1)])[0]
            del self.starts[rest]
            starts = new()
            for j in range(index - 1):
                starts.push(base(j), j, j + 2)
            cost, i = starts.least(index)
        return (cost, at(i)) if rest in self.unit else (math.inf, 0)


def base_spans(text: str, hexed: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping by kind."""
    low = text.lower()
    out = []
    if any(w in low for w in ("password", "passwd", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hexed:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guess_spans(text: str, min_cost: float, guesser: Guesser) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, cost) of values in a credential context that need 10**min_cost guesses or more."""
    low = text.lower()
    if not any(w in low for w in HINTS):
        return []
    out, k = [], 0
    while m := CONTEXT.search(text, k):
        k = m.end()
        if m[1] is not None:
            broken = max((x.end() for x in BROKEN.finditer(m[1])), default=0)
            if not any(x.end() >= broken for x in NAME.finditer(m[1])):
                continue
        value = VALUE.match(text, SCHEME.match(text, k).end() if m[1] is not None else k)
        if value:
            k = value.end()
            cost = guesser.cost(value[0])[0]
            if cost >= min_cost:
                out.append((value.start(), 3, k, cost))
    return out


def corpus_words(docs: DataFrame, most: int = 20_000, least: int = 3) -> list[str]:
    """At most ``most`` of the most frequent words of all texts, most frequent first: runs of ``least`` to 24 letters, in lower case.

    Words are counted over all documents.  A histogram of the counts, in sixteenths of a doubling, gives the least count at which no
    more than ``most`` words are left, so only those reach the driver, however many tasks there are.
    """
    word = F.explode(F.split(F.lower(F.col("text")), r"[^\p{L}]+"))
    count = id_text(docs).select(word.alias("word")).where(f"length(word) BETWEEN {least} AND 24").groupBy("word").agg(F.count("*").alias("n"))
    with Scratch(docs.sparkSession) as scratch:
        count = scratch.stored(count.withColumn("level", F.floor(F.log2("n") * 16).cast("int")), "words")
        levels = sorted(((r.level, r.words) for r in count.groupBy("level").agg(F.count("*").alias("words")).collect()), reverse=True)
        total, cut = 0, None
        for level, words in levels:  # some hundreds at most
            total += words
            if total > most:
                break
            cut = level
        rows = count.where(F.col("level") >= cut).select("word", "n").collect() if cut is not None else []
    return [r.word for r in sorted(rows, key=lambda r: (-r.n, r.word))]


_HEXES = np.zeros(256, np.int8)
_HEXES[list(b"0123456789abcdef")] = 1


def scan_secrets(docs: DataFrame, min_cost: float = 8.0, words: tuple[str, ...] | list[str] = WORDS) -> DataFrame:
    """Spans of secrets in every whole text; offsets are code points, ends exclusive.

    Per row: doc_id, base and guessed (arrays of kind, start, end, and the cost of the guessed).  Null and empty texts
    have none; repeated rows, equal ids and null ids give rows of their own; an empty table gives none.  Very long texts and
    values are scanned whole, in nearly linear time.  Of spans that start together, the fixed patterns come first.
    Other columns are left out, whatever their names.  ``words`` are ranked, the likeliest first.
    """
    out = "doc_id long, base array<struct<kind:string,start:long,end:long>>, guessed array<struct<kind:string,start:long,end:long,cost:double>>"
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    priced = pa.struct([*span, pa.field("cost", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(list(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(shared.value)
        for rows in slices(batches):
            data, off = spaced(*buffers(rows.column("text")))
            edge = np.flatnonzero(np.diff(_HEXES[data], prepend=np.int8(0), append=np.int8(0)))
            hexed = np.zeros(rows.num_rows, bool)
            hexed[np.searchsorted(off, edge[0::2][edge[1::2] - edge[0::2] >= 24], "right") - 1] = True
            base, guessed = [], []
            for text, has in zip(rows.column("text").to_pylist(), hexed, strict=True):
                base.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in base_spans(text, has)])
                guessed.append([{"kind": KINDS[k], "start": a, "end": b, "cost": cost} for a, k, b, cost in guess_spans(text, min_cost, guesser)])
            yield pa.record_batch([rows.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(guessed, pa.list_(priced))], names=["doc_id", "base", "guessed"])

    return id_text(docs).mapInArrow(tidied(run), out)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = scan_secrets(docs, words=[*WORDS, *corpus_words(docs)])

    def joined(c: F.Column) -> F.Column:
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    both = F.concat("base", F.transform("guessed", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    ordered = F.transform(F.array_sort(F.transform(both, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(ordered).alias("spans"), F.size("guessed").cast("long").alias("n_guess"))


QUERIES = {"op3_secret_scan": op3_secret_scan}
SQL: dict[str, str] = {}

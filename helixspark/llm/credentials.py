"""Secrets in texts: fixed patterns, and values in credential contexts that would be dear to guess.

Contexts. Beside the fixed patterns, values are looked for where people write credentials: behind a word for one and a mark
(``pwd: ...``, ``passphrase is "..."``), behind a flag, behind ``bearer``, as the password of a URL.

Guess cost. What a guesser would pay for a value is the least sum, over all ways to cut it into spans, of each span's cost in
powers of ten: a word (how rare it is in all texts, its capitals and letters written as digits), a date, a repeat of what
stands before, a walk on the keyboard, or characters by brute force (ten guesses each). A dynamic program over the value's
places finds it. Values from ``LEAST`` on are spans of kind "guess"; ``hunter2`` and ``Summer2024!`` stay below.

Words. Each text's words are counted over the whole corpus (words inside the values themselves don't count, so a secret that
many texts share is no word). Only different values go on: their substrings are joined to the counts, and what is known of a
stretch of ``STRETCH`` characters comes back to it, so no task holds more than a stretch's words. A longer value costs as
much as its dearest stretch. Both sides of each join grow with the corpus and more than their files tell (a value has
hundreds of substrings), so they are merged: neither is broadcast through the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table

KINDS = ("assign", "access", "hex", "guess")
#: Powers of ten of guesses from which a value is a secret, characters of the shortest one and of a stretch, letters of words.
LEAST, SHORTEST, STRETCH, WORD = 8.0, 6, 128, (3, 20)

# The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of 20 or more is matched whole, a shorter one not at all
_HEX = re.compile(r"[0-9a-f]{24,}")

_NAME = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret|auth|encryption)[_\x20-]?key|credentials?|auth|login)"
_VALUE = r"""(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"',;<>()]+))"""
_CONTEXTS = (
    (("pass", "pwd", "secret", "token", "key", "cred", "auth", "login"), re.compile(rf"""{_NAME}["'\]]{{0,2}}\s{{0,20}}(?::=|=>|->|[:=]|\bis\b)\s{{0,20}}{_VALUE}""", re.A | re.I)),
    (("--",), re.compile(rf"""--{_NAME}\x20{{1,20}}{_VALUE}""", re.A | re.I)),
    (("bearer",), re.compile(rf"""\bbearer\s{{1,20}}{_VALUE}""", re.A | re.I)),
    (("://",), re.compile(r"""://[^\s:/@]*:([^\s@/]+)@""")),
)

KIND = math.log10(5)  # which of the five kinds a span is
_LEET = str.maketrans("01345789@$!", "oleastbgasi")
_KEYS = {c: (x + (y > 0), y) for rows in (("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"), ("~!@#$%^&*()_+", "QWERTYUIOP{}|", 'ASDFGHJKL:"', "ZXCVBNM<>?")) for y, row in enumerate(rows) for x, c in enumerate(row)}
_STEPS = {(-1, 0), (1, 0), (0, -1), (1, -1), (0, 1), (-1, 1)}
_DATES = (re.compile(r"(\d{1,2})([-/._]?)(\d{1,2})\2(\d{4}|\d{2})", re.A), re.compile(r"(\d{4})([-/._]?)(\d{1,2})\2(\d{1,2})", re.A))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, in order; code points, end exclusive."""
    found = [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "key")):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return sorted(found)


def context_values(text: str) -> list[tuple[int, int]]:
    """Places of values in credential contexts, each once, in order."""
    low, found = text.lower(), set()
    for words, pattern in _CONTEXTS:
        if any(w in low for w in words):
            for m in pattern.finditer(text):
                found.add(m.span(m.lastindex))
    return sorted((a, b) for a, b in found if b - a >= SHORTEST)


def _plain(text: str) -> str:
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def possible_words(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(start, length, replaced letters, word) of all substrings that read as letters, as they stand and with digits read as letters."""
    low = _plain(text)
    read = low.translate(_LEET)
    replaced = [0]
    for a, b in zip(low, read, strict=True):
        replaced.append(replaced[-1] + (a != b))
    for i in range(len(low)):
        for n in range(1, min(WORD[1], len(low) - i) + 1):
            if not read[i + n - 1].isalpha():
                break
            if n < WORD[0]:
                continue
            subs = replaced[i + n] - replaced[i]
            if subs == 0 or low[i : i + n].isalpha():
                yield i, n, 0, low[i : i + n]
            if subs:
                yield i, n, subs, read[i : i + n]


def _capitals(part: str) -> float:
    upper, lower = sum(c.isupper() for c in part), sum(c.islower() for c in part)
    if not upper:
        return 0.0
    if not lower or part[0].isupper() and upper == 1:
        return math.log10(2)
    return math.log10(sum(math.comb(upper + lower, k) for k in range(1, min(upper, lower) + 1)))


def date_cost(part: str) -> float | None:
    """Of a year (1900 to 2059) or a whole date."""
    if len(part) == 4 and part.isascii() and part.isdigit() and 1900 <= int(part) <= 2059:
        return math.log10(160)
    for k, pattern in enumerate(_DATES):
        if m := pattern.fullmatch(part):
            year, one, two = (m[4], m[1], m[3]) if k == 0 else (m[1], m[3], m[4])
            if 1 <= max(int(one), int(two)) <= 31 and 1 <= min(int(one), int(two)) <= 12 and (len(year) == 2 or 1900 <= int(year) <= 2059):
                return math.log10(366 * (160 if len(year) == 4 else 100)) + (math.log10(5) if m[2] else 0.0)
    return None


def guess_cost(text: str, words: list[tuple[int, int, int, float]]) -> float:
    """Powers of ten of guesses; words: (start, length, replaced letters, the word's own cost)."""
    n = len(text)
    spans: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]  # by end: (start, cost)
    for i, size, subs, cost in words:
        spans[i + size].append((i, cost + _capitals(text[i : i + size]) + subs * math.log10(2)))
    for i in range(n):
        if "0" <= text[i] <= "9":
            for size in range(4, min(10, n - i) + 1):
                if (cost := date_cost(text[i : i + size])) is not None:
                    spans[i + size].append((i, cost))
        turns, step, j = 0, None, i + 1
        while j < n and text[j] in _KEYS and text[j - 1] in _KEYS:
            move = (_KEYS[text[j]][0] - _KEYS[text[j - 1]][0], _KEYS[text[j]][1] - _KEYS[text[j - 1]][1])
            if move not in _STEPS:
                break
            turns, step, j = turns + (move != step), move, j + 1
            if j - i >= 3:
                spans[j].append((i, math.log10(len(_KEYS)) + turns * math.log10(6) + math.log10(j - i)))
        for unit in range(1, i + 1):  # further copies of the unit characters before i
            copies = 1
            while text[i + (copies - 1) * unit : i + copies * unit] == text[i - unit : i] and i + copies * unit <= n:
                spans[i + copies * unit].append((i, math.log10(unit * copies)))
                copies += 1
    best, brute = [0.0] * (n + 1), math.inf
    for j in range(1, n + 1):
        brute = min(best[j - 1] + KIND, brute) + 1.0
        best[j] = min([brute, *(best[i] + KIND + cost for i, cost in spans[j])])
    return best[n]


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_HELD = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("covered", pa.bool_()), ("value", pa.string())])


def _costs(values: DataFrame, texts: DataFrame) -> DataFrame:
    """(value_key, cost) of each different value. texts: (text); values: (value_key, value), a row for each place."""
    low, high = WORD
    split = lambda c: F.explode(F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w).between(low, high)))
    inside = values.select(split("value").alias("word")).groupBy("word").agg(F.count("*").alias("inside"))
    counts = texts.select(split("text").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = materialize(counts.join(inside.hint("merge"), "word", "left").select("word", (F.col("n") - F.coalesce("inside", F.lit(0))).alias("n")).filter("n > 0"))
    whole = total.agg(F.sum("n")).first()[0] or 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(k, i // STRETCH, v[i : i + STRETCH]) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i in range(0, len(v), STRETCH)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 3, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["value_key", "stretch", "part"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = [(k, s, *w) for k, s, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in possible_words(p)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["value_key", "stretch", "at", "size", "subs", "word"])

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, parts, known = (c.to_pylist() for c in batch.columns)
            cost = [guess_cost(p, [(w["at"], w["size"], w["subs"], math.log10(max(1.0, whole / w["n"]))) for w in ws or ()]) for p, ws in zip(parts, known, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(cost, pa.float64())], names=["value_key", "cost"])

    stretches = materialize(values.dropDuplicates(["value_key"]).select("value_key", "value").mapInArrow(cut, "value_key string, stretch long, part string"))
    known = stretches.mapInArrow(read, "value_key string, stretch long, at int, size int, subs int, word string").join(total.hint("merge"), "word")
    lists = known.groupBy("value_key", "stretch").agg(F.collect_list(F.struct("at", "size", "subs", "n")).alias("known"))
    priced = stretches.join(lists.hint("merge"), ["value_key", "stretch"], "left").select("value_key", "part", "known").mapInArrow(price, "value_key string, cost double")
    return priced.groupBy("value_key").agg(F.max("cost").alias("cost"))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, guesses, found.

    Spans are kind:start:end in code points, end exclusive, by start and kind; base_sha256 is the digest of the base kinds'
    alone. A value that lies in a base span adds no span of its own. guesses: the highest cost of the row's values in powers of ten,
    null without one. found: the spans as structs. Null and empty texts have no spans; a null id stays null; repeated rows
    stay; other columns are left out; an empty table gives an empty table.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base, values = [], []
            for text in batch.column(1).to_pylist():
                found = base_spans(text) if text else []
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in found])
                values.append([{"start": a, "end": b, "covered": any(x <= a and b <= y for x, _, y in found), "value": text[a:b]} for a, b in context_values(text)] if text else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(values, pa.list_(_HELD))], names=["id", "base", "held"])

    span = "array<struct<start: long, kind: int, end: long>>"
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(texts.mapInArrow(scan, f"id {kind}, base {span}, held array<struct<start: long, end: long, covered: boolean, value: string>>").withColumn("row", F.monotonically_increasing_id()))
    held = rows.select("row", F.explode("held").alias("v")).select("row", "v.*").withColumn("value_key", F.sha2("value", 256))
    costs = _costs(held.select("value_key", "value"), texts.select("text"))
    dear = F.when((F.col("cost") >= least) & ~F.col("covered"), F.struct("start", F.lit(3).alias("kind"), "end"))
    added = held.drop("value").join(costs.hint("merge"), "value_key").groupBy("row").agg(F.collect_list(dear).alias("added"), F.max("cost").alias("guesses"))
    every = rows.drop("held").join(added.hint("merge"), "row", "left").withColumn("found", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(span)))))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return every.select(F.col("id").alias(id_col), *map(count, range(3)), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"), F.round("guesses", 6).alias("guesses"), "found")


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return find_secrets(table(spark, sf_dir)).drop("found")

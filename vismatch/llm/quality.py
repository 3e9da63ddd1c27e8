"""Quality rules as a short-circuit cascade.

Every rule is a pure function of the text. On a sample of bounded expected size each rule's cost (seconds a text) and
selectivity (share of texts it rejects) are measured; the cascade then runs the rules by rejections per second, highest
first, and stops at a text's first rejection. The order changes the time only: a text is kept if no rule rejects it.

Words are runs of anything but the six ASCII blanks. Defined cases: a null or empty text has no words and is rejected
as too short; the rules look at whole texts of any length; repeated rows are judged alike; other columns, whatever
their names, pass through ``filter_documents``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BLANKS, Rolling, WordHash, as_bytes, blocks

SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_CONTINUATION = bytes(range(0x80, 0xC0))
_REPEAT_WINDOW = 8

_hashed, _rolling = WordHash(), Rolling()


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


class Text:
    """A text with the measures of its words, each made at most once."""

    def __init__(self, raw: bytes | None) -> None:
        self.raw = raw or b""
        self._words: list[bytes] | None = None
        self._hashes: np.ndarray | None = None

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.raw.split()
        return self._words

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = _hashed.of(self.words)
        return self._hashes

    def n_words(self) -> int:
        return len(self.words)

    def word_chars(self) -> int:
        """Code points in words: all bytes but blanks and the second and later bytes of a code point."""
        return len(self.raw.translate(None, BLANKS + _CONTINUATION))

    def n_symbols(self) -> int:
        return _count(self.raw, SYMBOLS)

    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(BLANKS)]

    def n_dup_lines(self) -> int:
        lines = self.lines()
        return len(lines) - len(set(lines))

    def n_repeat_words(self) -> int:
        """Words inside windows of 8 words that the text has twice or more."""
        if len(self.words) <= _REPEAT_WINDOW:
            return 0
        windows = _rolling.windows(_rolling.prefix(self.hashes), _REPEAT_WINDOW)
        order = np.argsort(windows)
        same = windows[order][1:] == windows[order][:-1]
        if not same.any():
            return 0
        twice = np.zeros(len(windows), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(self.words) + 1, np.int64)
        at = np.flatnonzero(twice)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + _REPEAT_WINDOW, -1)
        return int((np.cumsum(edge) > 0).sum())

    def n_adjacent(self) -> int:
        """Words equal to the one before them."""
        return int((self.hashes[1:] == self.hashes[:-1]).sum()) if len(self.words) > 1 else 0


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: The two rules of the base contract, then the cascade's own. All compare integers, so SQL can restate them exactly.
BASE_RULES = (
    Rule("too_short", lambda t: t.n_words() < 20),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words() > 30 * t.n_words()),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda t: 10 * t.n_symbols() > 3 * t.n_words()),
    Rule("shouting", lambda t: _count(t.raw, UPPER) > _count(t.raw, LOWER)),
    Rule("stuttering", lambda t: 5 * t.n_adjacent() > t.n_words()),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines() > len(t.lines())),
    Rule("long_words", lambda t: t.word_chars() > 40 * t.n_words()),
)
SAMPLE_ROWS = 2_000


def _timed(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, seen = [0.0] * len(rules), [0] * len(rules), 0
        for batch in blocks(batches):
            texts = as_bytes(batch.column("text"))
            seen += len(texts)
            for i, rule in enumerate(rules):
                began = time.perf_counter()
                rejected[i] += sum(rule.rejects(Text(x)) for x in texts)
                seconds[i] += time.perf_counter() - began
        yield pa.record_batch([list(range(len(rules))), seconds, rejected, [seen] * len(rules)], names=["rule", "seconds", "rejected", "seen"])

    return run


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> tuple[Rule, ...]:
    """The rules by rejections per second on a sample of about ``sample_rows`` rows; a row a rule reaches the driver."""
    rows = docs.count()
    sample = docs.select(F.col("text").cast("string").alias("text")).sample(min(1.0, sample_rows / max(rows, 1)), seed)
    schema = "rule long, seconds double, rejected long, seen long"
    found = sample.mapInArrow(_timed(rules), schema).groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r")).collect()
    gain = {x["rule"]: x["r"] / max(x["s"], 1e-9) for x in found}
    return tuple(rules[i] for i in sorted(range(len(rules)), key=lambda i: (-gain.get(i, 0.0), i)))


def _first_rejection(text: Text, ordered: tuple[Rule, ...]) -> str | None:
    return next((rule.name for rule in ordered if rule.rejects(text)), None)


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judged(ordered: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = tuple(r for r in ordered if r not in BASE_RULES)
        for batch in blocks(batches):
            rows = []
            for raw in as_bytes(batch.column("text")):
                t = Text(raw)
                measured = [getattr(t, m)() for m in _MEASURES]
                n_words, *_, n_repeat = measured
                failed = n_words < 20 or 100 * n_repeat > 30 * n_words  # measured already; the cascade has the others
                rows.append((*measured, failed, not failed and _first_rejection(t, rest) is None))
            columns = [pa.array(c) for c in zip(*rows)]
            yield pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", *_MEASURES, "base_failed", "kept"])

    return run


def judge_documents(docs: DataFrame, ordered: tuple[Rule, ...]) -> DataFrame:
    """A row for each document: its base measures, whether a base rule failed, and the cascade's verdict."""
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in _MEASURES) + ", base_failed boolean, kept boolean"
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(_judged(ordered), schema)


def filter_documents(docs: DataFrame, ordered: tuple[Rule, ...]) -> DataFrame:
    """The documents that no rule rejects, with all their columns; each text stops at its first rejection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield batch.filter(pa.array([_first_rejection(Text(raw), ordered) is None for raw in as_bytes(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Phrases mined from texts by Apriori passes over their words.

A pass counts the phrases of k words. It gets the frequent phrases of k - 1 words as a broadcast and emits a phrase only
where both phrases of k - 1 words inside it are frequent. The broadcast is a bit for each hash, 32 bits a phrase and
2**28 bits at most, so its size is bounded; a bit that other phrases share lets a rare phrase through, which its count
then drops, so results do not depend on hashes. A task tells words and phrases apart by their bytes, adds up those of a
block of texts, and Spark adds up the blocks' rows before and after the shuffle by phrase.

Each candidate is then cut in two at each place, the parts' counts are joined from the tables of the levels, and the
lowest score counts; products have up to 38 digits. A candidate lies inside a longer one of the same count only if it
lies inside one with a word more of that count, so only those are compared.

Defined cases: null and empty texts have no words; a null language is ``und`` and shares its counts; repeated rows count
each time; a text is read in slices that end at piece ends, so memory follows its longest piece; an empty table or one
without frequent words gives no rows. Only the columns lang and text are read. Scores are exact below 10**15 occurrences
of a phrase and 10**17 words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Rolling, as_bytes, materialise, mix, shared_dir

BREAKS = b".,;:!?\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SLICE_BYTES = 1 << 21
LARGEST_LOG = 28
_BREAK, _WORD = np.zeros(256, bool), np.ones(256, bool)
_BREAK[list(BREAKS)] = True
_WORD[list(BREAKS + b" \t")] = False
_END = re.compile(b"[" + re.escape(BREAKS) + b"]")
_STEP = np.uint64(0xD1342543DE82EF95)
_rolling = Rolling()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts and their languages, about SLICE_BYTES at once; a longer text is cut at the ends of pieces."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for raw, lang in zip(as_bytes(batch.column("text")), batch.column("lang").to_pylist()):
            at = 0
            while raw and at < len(raw):
                end = len(raw)
                if end - at > SLICE_BYTES and (found := _END.search(raw, at + SLICE_BYTES)):
                    end = found.end()
                texts.append(raw[at:end])
                langs.append(lang)
                size, at = size + end - at, end
                if size >= SLICE_BYTES:
                    yield texts, langs
                    texts, langs, size = [], [], 0
    if texts:
        yield texts, langs


def _coded(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, number of each place among the distinct values, and times of the values, which are below ``most``."""
    if most > 4 * len(values) + 1024:
        _, first, code, times = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
        return first, code, times
    times = np.bincount(values, minlength=most)
    there = np.flatnonzero(times)
    number, first = np.zeros(most, np.int64), np.zeros(most, np.int64)
    number[there] = np.arange(len(there))
    first[values[::-1]] = np.arange(len(values))[::-1]  # the last that is written stays
    return first[there], number[values], times[there]


def _hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word's bytes and length."""
    at = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    sums, inverse, at = _rolling.prefix(raw.astype(np.uint64) + np.uint64(1)), _rolling.inverse, at - at[0]
    return mix((sums[at[1:]] - sums[at[:-1]]) * inverse[at[:-1]] + np.diff(at).astype(np.uint64) * _STEP)


class Words:
    """The words of some texts in order: their codes by language and bytes, their hashes, and the pieces they stand in."""

    def __init__(self, texts: list[bytes], langs: list[str]) -> None:
        data = b"\n".join(texts).translate(LOWER)
        raw = np.frombuffer(data, np.uint8)
        inside = np.concatenate([[False], _WORD[raw], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside[1:-1]])])
        coded = words.dictionary_encode()
        self.vocabulary, self.word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.piece = np.cumsum(_BREAK[raw], dtype=np.int32)[start]
        ends = np.cumsum([len(t) + 1 for t in texts])
        named = pa.array(langs, pa.string()).dictionary_encode()
        self.langs = named.dictionary
        self.lang = named.indices.to_numpy(zero_copy_only=False)[np.searchsorted(ends, start, "right")]
        self.first, self.code, self.times = _coded(self.lang.astype(np.int64) * len(self.vocabulary) + self.word, len(self.langs) * len(self.vocabulary))
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs.to_pylist()], np.uint64)
        self.hash = mix(_hashes(self.vocabulary)[self.word[self.first]] ^ seeds[self.lang[self.first]])[self.code]

    def hashes(self, k: int) -> np.ndarray:
        """Hash of the k words that begin at each place."""
        out = self.hash
        for j in range(1, k):
            out = mix(out[:-1] * _STEP + self.hash[j:])
        return out

    def table(self, at: np.ndarray, k: int, times: np.ndarray) -> pa.RecordBatch:
        """Rows lang, phrase, n for the phrases of k words that begin at the places."""
        words = [self.vocabulary.take(pa.array(self.word[at + j])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*words, " ") if k > 1 else words[0]
        return pa.record_batch([self.langs.take(pa.array(self.lang[at])), phrase, times], names=["lang", "phrase", "n"])


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and with a null phrase those of all words of a language."""
    for texts, langs in _slices(batches):
        w = Words(texts, langs)
        yield w.table(w.first, 1, w.times)
        total = np.bincount(w.lang, minlength=len(w.langs))
        yield pa.record_batch([w.langs, pa.nulls(len(total), pa.string()), total], names=["lang", "phrase", "n"])


def _hashed(k: int):
    """The hashes of phrases of k words, as at their places in texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 65_536):
                part = batch.slice(at, 65_536)
                w = Words(as_bytes(part.column("phrase")), part.column("lang").to_pylist())
                yield pa.record_batch([w.hashes(k)[::k].view(np.int64)], names=["h"])

    return run


class Frequent:
    """A set of hashes as bits by their first digits; it may hold more than was put in."""

    def __init__(self, bits: np.ndarray, log: int) -> None:
        self.bits, self.log = bits, log

    @classmethod
    def of(cls, level: DataFrame, k: int, rows: int) -> Frequent:
        log = min(LARGEST_LOG, max(15, math.ceil(math.log2(32 * max(rows, 1)))))
        number = F.shiftrightunsigned("h", 64 - log) + 1
        parts = level.select("lang", "phrase").mapInArrow(_hashed(k), "h long").groupBy(F.bitmap_bucket_number(number).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("m"))
        bits = np.zeros(1 << log - 3, np.uint8)
        for b, m in parts.collect():  # 4 KB each, 2 ** (log - 15) rows at most
            bits[(b - 1) * 4096 : b * 4096] = np.frombuffer(m, np.uint8)
        return cls(bits, log)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self.log)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _longer(k: int, frequent: Broadcast):
    """Counts of phrases of k words both of whose parts of k - 1 words are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in _slices(batches):
            w = Words(texts, langs)
            if len(w.word) < k:
                continue
            part = frequent.value.has(w.hashes(k - 1))
            at = np.flatnonzero((w.piece[k - 1 :] == w.piece[: 1 - k]) & part[:-1] & part[1:])
            if not len(at):
                continue
            ids = w.code[at]
            for j in range(1, k - 1):
                ids = np.unique(ids * np.int64(len(w.first)) + w.code[at + j], return_inverse=True)[1]
            _, first, times = np.unique(ids * np.int64(len(w.first)) + w.code[at + k - 1], return_index=True, return_counts=True)
            yield w.table(at[first], k, times)

    return run


def phrase_counts(docs: DataFrame, least: int, longest: int, folder: str) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n: all its words), and for k = 1 to ``longest`` the phrases of k words found ``least`` times or more: lang, phrase, a."""
    rows = "lang string, phrase string, n long"
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    added = lambda emitted: emitted.groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
    single = materialise(added(own.mapInArrow(_single, rows)).filter(f"phrase is null or a >= {least}"), f"{folder}/level1")
    totals, levels = single.filter("phrase is null").select("lang", F.col("a").alias("n")), [single.filter("phrase is not null")]
    for k in range(2, longest + 1):
        if not (found := levels[-1].count()):
            break
        shared = docs.sparkSession.sparkContext.broadcast(Frequent.of(levels[-1], k - 1, found))
        levels.append(materialise(added(own.mapInArrow(_longer(k, shared), rows)).filter(f"a >= {least}"), f"{folder}/level{k}"))
        shared.unpersist()
    return totals, levels


def mine_phrases(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2_000) -> DataFrame:
    """The best phrases of each language by their lowest-scoring cut: lang, rank, phrase, a, l, r, n, score."""
    totals, levels = phrase_counts(docs, least, longest, shared_dir(docs.sparkSession))
    every = reduce(DataFrame.unionByName, [t.select("lang", "phrase", "a", F.lit(k).alias("k")) for k, t in enumerate(levels, 1)])
    candidates = every.filter("k >= 2").withColumn("w", F.split("phrase", " "))
    joined = lambda first, size: F.expr(f"array_join(slice(w, {first}, {size}), ' ')")
    inside = candidates.filter("k >= 3").select("lang", F.col("a").alias("longer"), F.explode(F.array(joined("1", "k - 1"), joined("2", "k - 1"))).alias("phrase"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(covered, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < 100 * a").drop("longer")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", joined("1", "cut").alias("first"), joined("cut + 1", "k - cut").alias("rest"))
    part = lambda name, as_: every.select("lang", F.col("phrase").alias(name), F.col("a").alias(as_))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    product = "1000 * cast(a as decimal(15)) * cast(n as decimal(17)) div (cast(l as decimal(18)) * cast(r as decimal(18)))"
    lowest = F.min(F.struct(F.expr(product).alias("score"), "cut", "l", "r")).alias("c")
    best = scored.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

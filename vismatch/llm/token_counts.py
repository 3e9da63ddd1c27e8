"""Numbers of tokens of texts, with each distinct pre-token counted once.

Texts are cut where the vocabulary's pre-tokenizer always cuts: at spaces, tabs and line ends, which it drops, and between
ASCII letters, digits and punctuation next to each other. Runs with other characters, apostrophes or a character of an
added token stay whole, since normal forms, contractions and added tokens may join what stands there; the library cuts
them. ASCII runs are put into lower case, as the normaliser does. So a run's tokens do not depend on what is around it.

First the distinct runs of all texts are counted, and the library encodes each one once. The keys of the most frequent
runs (the run, or a digest of one of over ``SHORT`` bytes), up to ``HEAD``, are a broadcast of bounded size; a text's other
runs are counted for each text and joined to the table of runs by key, and both numbers are added up by row. No ids of
tokens are kept or moved. A run outside the broadcast is in fewer texts than each in it, so no key of the join is hot.

Defined cases: null and empty texts have no bytes and no tokens; each row counts for itself, also with a null or repeated
id; a text is read in slices that end at blanks, so memory follows its longest run; an empty table gives no rows.
Vocabularies whose rules are not those above are refused. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, drop, materialise, shared_dir

HEAD, SHORT = 1 << 17, 64
SLICE_BYTES = 1 << 21
LIMIT = 2_048
_BLANKS = b" \t\n\r"
_BLANK = re.compile(b"[" + _BLANKS + b"]")
# The rules of the vocabulary that the cuts rely on.
_NORMALISERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LETTER, _DIGIT, _MARK, _OTHER = 1, 2, 3, 4
_KIND = np.full(256, _OTHER, np.uint8)  # control characters and bytes of other characters decide nothing
_KIND[33:127] = _MARK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[list(_BLANKS)] = 0


def special_bytes(tokenizer: str) -> bytes:
    """First bytes of the added tokens, and the apostrophe; an error if the vocabulary's rules do not allow the cuts."""
    with open(tokenizer, encoding="utf-8") as file:
        rules = json.load(file)
    normal, before, added = rules["normalizer"] or {}, rules["pre_tokenizer"] or {}, rules["added_tokens"]
    split = next(iter(before.get("pretokenizers", [])), {})
    fits = (
        [n["type"] for n in normal.get("normalizers", [])] == _NORMALISERS and split.get("pattern") == {"Regex": _PATTERN} and split.get("invert") and split.get("behavior") == "Removed"
        and rules["post_processor"] is None and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or _BLANK.search(t["content"].encode()) for t in added)
    )
    if not fits:
        raise ValueError("the vocabulary cuts texts by other rules")
    return bytes({ord("'"), *(t["content"].encode()[0] for t in added)})


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[tuple[int, bytes]], bool]]:
    """(batch, first row, pieces of its texts with their rows, whether more pieces of the batch follow)."""
    for batch in batches:
        held, size = [], 0
        for row, raw in enumerate(as_bytes(batch.column("text"))):
            at = 0
            while raw and at < len(raw):
                end = len(raw)
                if end - at > SLICE_BYTES and (found := _BLANK.search(raw, at + SLICE_BYTES)):
                    end = found.end()
                held.append((row, raw[at:end]))
                size, at = size + end - at, end
                if size >= SLICE_BYTES:
                    yield batch, held, True
                    held, size = [], 0
        yield batch, held, False


def runs(texts: list[bytes], special: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct runs, the number of each run of the texts among them, and the text of each."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8).copy()
    kind = _KIND[raw]
    inside = kind > 0
    start = inside & ~np.concatenate([[False], inside[:-1]])
    chunk = np.cumsum(start, dtype=np.int32)  # of the bytes between blanks
    whole = np.zeros(int(chunk[-1]) + 1 if len(chunk) else 1, bool)
    odd = np.zeros(256, bool)
    odd[list(special)] = True
    whole[chunk[inside & (odd[raw])]] = True
    foreign = np.zeros(len(whole), bool)
    foreign[chunk[inside & (kind == _OTHER)]] = True
    plain = ~whole[chunk]
    before = np.concatenate([kind[:1], kind[:-1]])
    cut = inside & plain & (before > 0) & (before != _OTHER) & (kind != _OTHER) & ((kind != before) | (kind == _DIGIT))
    upper = inside & plain & ~foreign[chunk] & (raw >= 65) & (raw <= 90)
    raw[upper] += 32
    first = np.flatnonzero(start | cut)
    place = np.cumsum(inside, dtype=np.int64) - 1
    offsets = np.concatenate([place[first], place[-1:] + 1]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    ends = np.cumsum([len(t) + 1 for t in texts])
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(ends, first, "right")


def _keys(found: pa.Array) -> list[str]:
    """The runs; for a long one a digest, which no run equals since it begins with a space."""
    keys = found.to_pylist()
    for i in np.flatnonzero(pc.binary_length(found).to_numpy(zero_copy_only=False) > SHORT).tolist():
        keys[i] = " " + hashlib.sha256(keys[i].encode()).hexdigest()
    return keys


def _distinct(special: bytes):
    """Rows key, run, n: how often each run occurs in a slice."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held, _ in _slices(batches):
            found, code, _ = runs([t for _, t in held], special)
            keys = _keys(found)
            yield pa.record_batch([pa.array(keys, pa.string()), found, np.bincount(code, minlength=len(found))], names=["key", "run", "n"])

    return rows


_libraries: dict[str, object] = {}


def _library(path: str):
    """The vocabulary, loaded once by a worker, without padding and truncation."""
    if path not in _libraries:
        from tokenizers import Tokenizer

        own = _libraries[path] = Tokenizer.from_file(path)
        own.no_padding()
        own.no_truncation()
    return _libraries[path]


def _encoded(tokenizer: str):
    """key, n, tokens: the library's number of tokens of each run."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                tokens = [len(e) for e in library.encode_batch(part.column("run").to_pylist(), add_special_tokens=False)]
                yield pa.record_batch([part.column("key"), part.column("n"), pa.array(tokens, pa.int64())], names=["key", "n", "tokens"])

    return rows


def _by_text(special: bytes, head: Broadcast):
    """A row for each text with the tokens of its runs in the head, and one for each of its other runs: row, doc_id,
    n_bytes, tokens; and row, key, times."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        number = TaskContext.get().partitionId() << 40
        sums: np.ndarray | None = None
        for batch, held, more in _slices(batches):
            sums = np.zeros(batch.num_rows, np.int64) if sums is None else sums
            found, code, text = runs([t for _, t in held], special)
            keys = _keys(found)
            tokens = np.array([known.get(k, -1) for k in keys], np.int64)[code] if keys else np.zeros(0, np.int64)
            owner = np.array([r for r, _ in held], np.int64)[text] if held else np.zeros(0, np.int64)
            np.add.at(sums, owner, np.maximum(tokens, 0))
            rest = tokens < 0
            pair, times = np.unique(owner[rest] * max(1, len(keys)) + code[rest], return_counts=True)
            if len(pair):
                at, which = pair // len(keys), pair % len(keys)
                none = pa.nulls(len(pair), pa.int64())
                yield pa.record_batch([number + at, none, none, none, pa.array(keys, pa.string()).take(pa.array(which)), times], names=_COLUMNS)
            if not more:
                n = batch.num_rows
                size = pa.array([len(t or b"") for t in as_bytes(batch.column("text"))], pa.int64())
                yield pa.record_batch([number + np.arange(n), batch.column("doc_id"), size, sums, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names=_COLUMNS)
                number, sums = number + n, None

    return rows


_COLUMNS = ["row", "doc_id", "n_bytes", "tokens", "key", "times"]


def run_table(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """key, n, tokens of each distinct run of the texts."""
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_distinct(special_bytes(tokenizer)), "key string, run string, n long")
    counted = found.groupBy("key").agg(F.max("run").alias("run"), F.sum("n").alias("n"))
    return materialise(counted.mapInArrow(_encoded(tokenizer), "key string, n long, tokens long"), f"{folder}/runs")


def frequent_runs(table: DataFrame, most: int) -> DataFrame:
    """key, tokens of the most frequent runs, ``most`` at most: those from a number of occurrences on, steps of an eighth of
    a power of two, which a count by steps finds. What is left out is no more frequent than ``most`` others."""
    step = table.withColumn("step", F.floor(8 * F.log2("n")))
    sizes, least = 0, None
    for row in sorted(step.groupBy("step").agg(F.count("*").alias("runs")).collect(), reverse=True):  # 512 rows at most
        if (sizes := sizes + row["runs"]) > most:
            break
        least = row["step"]
    return step.filter(F.lit(False) if least is None else F.col("step") >= least).select("key", "tokens")


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each document."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    table = run_table(docs, tokenizer, folder)
    known = spark.sparkContext.broadcast({r["key"]: r["tokens"] for r in frequent_runs(table, HEAD).collect()})
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialise(own.mapInArrow(_by_text(special_bytes(tokenizer), known), "row long, doc_id long, n_bytes long, tokens long, key string, times long"), f"{folder}/texts")
    rest = rows.filter("key is not null").join(table.select("key", F.col("tokens").alias("each")), "key")
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("each")).alias("tokens"))
    texts = rows.filter("key is null").select("row", "doc_id", "n_bytes", "tokens")
    both = texts.unionByName(rest, allowMissingColumns=True).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    return both.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

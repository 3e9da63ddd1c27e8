"""Suffix-array deduplication of passages that repeat inside or across documents.

A full suffix array of the corpus has an entry for every word. Here only the suffixes that start at content-selected
minimiser positions are kept: among the ``min_words - seed_words + 1`` seeds of each window of ``min_words`` words, the
one with the smallest hash (the leftmost of equals). Equal windows choose the same position, so two places share a
window of ``min_words`` words exactly if the suffixes kept there match: ``o`` words leftwards and ``min_words - o``
words from the position on, for an ``o`` for which this position is the chosen one.

Frequency-aware order: seeds that are very common (found on a sample of the documents) rank behind all others, so that a
line which stands in many texts is chosen only where a window has nothing else. Any order gives the same spans; this
one keeps the groups of equal seeds small.

1. Each task slides over its texts and emits one record a kept suffix: the hash of its seed (the first words of the
   suffix, by which the array is sorted), the document, and a 48-bit hash for each left extension ``o`` that chose it.
   A context that a task has sent before is sent as its hash only.
2. The records are dealt and sorted by seed; equal ones are neighbours. Records of a seed that stands alone go. For the
   others, equal extension hashes are matched: a hash of ``min_words`` words stands for the words of both sides.
   Records of a seed that has more than ``HOT`` of them never meet in one task: they are added up by context, then by
   extension hash, each time before they are shuffled, and what is found comes back to them by context.
3. Matched extensions that follow each other form spans; a document's overlapping spans are merged.

Defined cases: texts that are null or shorter than ``min_words`` words have no spans; rows with a null document id count
as places after all others, so what they share with a document makes that document's span, but no result row names them;
rows that repeat an id count as copies of each other, and their common span
is reported once, as first. The first occurrence is the one with the smallest id, then the smallest start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Rolling, WordHash, as_bytes, blocks, materialise, shared_dir

_SAMPLES = "seed long, context long, doc_id long, start int, n int, times int, hashes binary"
_SPANS = "doc_id long, is_first boolean, start_word int, end_word int, first_doc_id long"
#: Records of a seed from which it is matched by its extensions, not in one task.
HOT = 200_000
_NO_ID = (1 << 63) - 1  # stands for null, after all ids
#: Contexts that a task remembers as sent.
_REMEMBERED = 300_000
#: Share of the documents on which common seeds are counted, and the share of all seeds from which one is common. At
#: most 1 / COMMON_SHARE seeds can be; they go to the tasks.
COMMON_SAMPLE = 0.1
COMMON_SHARE = 1 / 5_000


def _leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value of each window, by doubling."""
    at, done = np.arange(len(values)), 1
    while done < width:
        step = min(done, width - done)
        later = values[step:] < values[: len(values) - step]
        values = np.where(later, values[step:], values[: len(values) - step])
        at = np.where(later, at[step:], at[: len(at) - step])
        done += step
    return at


def _counted_seeds(seed_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, rolling, total, held = WordHash(), Rolling(), 0, []

        def flush() -> pa.RecordBatch:
            seeds, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= max(2, len(held) and sum(map(len, held)) * COMMON_SHARE / 2)
            return pa.record_batch([seeds[often].view(np.int64), count[often], np.zeros(int(often.sum()), np.int64)], names=["seed", "n", "total"])

        for batch in blocks(batches):
            for text in as_bytes(batch.column("text")):
                held.append(rolling.windows(rolling.prefix(hashed.of((text or b"").split())), seed_words))
                total += len(held[-1])
            if sum(map(len, held)) > 1_000_000:
                yield flush()
                held = []
        if held:
            yield flush()
        yield pa.record_batch([pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], names=["seed", "n", "total"])

    return run


def common_seeds(docs: DataFrame, seed_words: int) -> np.ndarray:
    """The seeds with at least COMMON_SHARE of all seeds of a sample, sorted; at most 1 / COMMON_SHARE of them."""
    counted = docs.select("text").sample(COMMON_SAMPLE, 5).mapInArrow(_counted_seeds(seed_words), "seed long, n long, total long")
    per = counted.groupBy("seed").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    most = round(1 / COMMON_SHARE)
    found = per.orderBy(F.desc("total"), F.desc("n"), "seed").limit(most + 1).collect()  # the total, then the most common
    least = max(2, sum(r["total"] for r in found) * COMMON_SHARE)
    return np.sort(np.array([r["seed"] for r in found if r["n"] >= least], np.int64).view(np.uint64))


def _kept_suffixes(min_words: int, seed_words: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, rolling, sent = WordHash(), Rolling(), set()
        for batch in blocks(batches):
            parts, blobs = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                words = (text or b"").split()
                if len(words) < min_words:
                    continue
                doc = _NO_ID if doc is None else doc
                prefix = rolling.prefix(hashed.of(words))
                seeds, whole = rolling.windows(prefix, seed_words), rolling.windows(prefix, min_words)
                order = seeds >> np.uint64(1)
                if len(common):
                    at = np.minimum(np.searchsorted(common, seeds), len(common) - 1)
                    order[common[at] == seeds] |= np.uint64(1 << 63)
                chosen = _leftmost_minima(order, min_words - seed_words + 1)
                first = np.flatnonzero(np.diff(chosen, prepend=-1))
                ends = np.append(first[1:], len(chosen))
                raw = np.ascontiguousarray(whole.view(np.uint8).reshape(-1, 8)[:, :6])
                data = raw.tobytes()
                contexts = np.empty(len(first), np.uint64)
                for i, (a, b) in enumerate(zip(first.tolist(), ends.tolist())):
                    contexts[i] = xxhash.xxh3_64_intdigest(data[6 * a : 6 * b], int(chosen[a]) - a)
                # where a text repeats itself, the same context follows itself: one record for the first, one for the rest
                rest = np.append(False, contexts[1:] == contexts[:-1])
                head = np.flatnonzero(~rest | ~np.append(False, rest[:-1]))
                times = np.diff(np.append(head, len(rest)))
                first, ends, contexts = first[head], ends[head], contexts[head]
                for a, b, key in zip(first.tolist(), ends.tolist(), contexts.tolist()):
                    if key in sent:
                        blobs.append(None)
                        continue
                    if len(sent) < _REMEMBERED:
                        sent.add(key)
                    blobs.append(data[6 * a : 6 * b])
                parts.append((seeds[chosen[first]], contexts, np.full(len(first), doc), first, ends - first, times))
            if parts:
                seed, context, doc, first, n, times = (np.concatenate(x) for x in zip(*parts))
                yield pa.record_batch(
                    [seed.view(np.int64), context.view(np.int64), doc.astype(np.int64), *(x.astype(np.int32) for x in (first, n, times)), pa.array(blobs, pa.binary())],
                    names=["seed", "context", "doc_id", "start", "n", "times", "hashes"],
                )

    return run


def _runs(owner: np.ndarray, at: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive places of one owner: owner, first place, one past the last, smallest source."""
    if not len(owner):
        return (np.zeros(0, np.int64),) * 4
    cut = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(at) != 1)))
    return owner[cut], at[cut], at[np.append(cut[1:], len(at)) - 1] + 1, np.minimum.reduceat(source, cut)


def _matched(seed, context, doc, start, n, times, blobs, min_words: int) -> pa.RecordBatch | None:
    """Spans of complete groups of equal seeds, sorted by seed."""
    new = np.append(True, seed[1:] != seed[:-1])
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    if not many.any():
        return None
    keep = np.flatnonzero(many)
    group, context, doc, start, n, times = group[keep], context[keep], doc[keep], start[keep].astype(np.int64), n[keep].astype(np.int64), times[keep]
    # one entry for each context; its first record is the one with the smallest (document, start)
    order = np.lexsort((start, doc, context, group))
    fresh = np.append(True, (np.diff(group[order]) != 0) | (np.diff(context[order]) != 0))
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(fresh) - 1
    lead = order[fresh]
    found = np.bincount(entry, times).astype(np.int64)
    data: list[bytes | None] = [None] * len(lead)
    for e, r in zip(entry.tolist(), keep.tolist()):
        if data[e] is None and blobs[r].is_valid:
            data[e] = blobs[r].as_py()
    size = n[lead]
    raw = np.zeros((int(size.sum()), 8), np.uint8)
    raw[:, :6] = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 6)
    value = raw.view(np.uint64)[:, 0]
    owner = np.repeat(np.arange(len(lead)), size)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    by_doc, by_at, by_group = doc[lead][owner], start[lead][owner] + place, group[lead][owner]
    order = np.lexsort((by_at, by_doc, value, by_group))
    fresh = np.append(True, (np.diff(by_group[order]) != 0) | (value[order][1:] != value[order][:-1]))
    same = np.cumsum(fresh) - 1
    total = np.bincount(same, weights=found[owner][order]).astype(np.int64)
    repeated, first_doc, is_first = (np.empty(len(order), x) for x in (bool, np.int64, bool))
    repeated[order], first_doc[order], is_first[order] = total[same] > 1, by_doc[order][fresh][same], fresh
    if not repeated.any():
        return None
    out = []
    lead_of = lead[entry]
    for flag, rows, of in (
        (False, np.flatnonzero((doc != doc[lead_of]) | (start != start[lead_of])), repeated),
        (False, lead, repeated & ~is_first),
        (True, lead, repeated & is_first),
    ):
        own, a, b, src = _runs(owner[of], place[of], first_doc[of])
        if not len(own) or not len(rows):
            continue
        lo, hi = np.searchsorted(own, entry[rows]), np.searchsorted(own, entry[rows], "right")
        count = hi - lo
        row = np.repeat(rows, count)
        run = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        out.append((doc[row], np.full(len(row), flag), start[row] + a[run], start[row] + b[run] + min_words - 1 + (times[row] - 1) * n[row], src[run]))
    if not out:
        return None
    d, f, a, b, s = (np.concatenate(x) for x in zip(*out))
    return pa.record_batch([d, f, a.astype(np.int32), b.astype(np.int32), s], names=["doc_id", "is_first", "start_word", "end_word", "first_doc_id"])


def _compared(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            seed = batch.column("seed").to_numpy()
            whole = int(np.searchsorted(seed, seed[-1]))  # the last group may go on in the next batch
            if whole:
                held.append(batch.slice(0, whole))
                if out := _flush(held, min_words):
                    yield out
                held = []
            elif held and held[-1].column("seed")[0].as_py() != seed[0]:
                if out := _flush(held, min_words):
                    yield out
                held = []
            held.append(batch.slice(whole))
        if held and (out := _flush(held, min_words)):
            yield out

    return run


def _flush(held: list[pa.RecordBatch], min_words: int) -> pa.RecordBatch | None:
    table = pa.Table.from_batches(held).combine_chunks()
    cols = [table.column(c).to_numpy() for c in ("seed", "context", "doc_id", "start", "n", "times")]
    return _matched(*cols, table.column("hashes").chunk(0) if table.num_rows else [], min_words)


def _matched_hot(records: DataFrame, min_words: int) -> DataFrame:
    """The spans of records whose seeds are hot, by aggregations that combine before they shuffle."""
    place = F.struct("doc_id", "start")
    entries = records.groupBy("seed", "context").agg(F.sum("times").alias("found"), F.min(place).alias("lead"), F.max("hashes").alias("hashes"), F.first("n").alias("n"))
    offsets = entries.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    windows = offsets.select("seed", "context", "found", "lead", "o", F.substring(F.hex("hashes"), 12 * F.col("o") + 1, F.lit(12)).alias("hash"))
    first = F.min(F.struct(F.col("lead.doc_id").alias("doc_id"), (F.col("lead.start") + F.col("o")).alias("at")))
    totals = windows.groupBy("seed", "hash").agg(F.sum("found").alias("total"), first.alias("first")).filter("total > 1")
    repeated = windows.join(totals, ["seed", "hash"]).select("seed", "context", "o", "first")
    found = repeated.groupBy("seed", "context").agg(F.collect_list(F.struct("o", "first")).alias("windows"))  # as many as the context has
    spans = records.select("seed", "context", "doc_id", "start", "n", "times").join(found, ["seed", "context"]).withColumn("w", F.explode("windows"))
    at = F.col("start") + F.col("w.o")
    is_first = (F.col("doc_id") == F.col("w.first.doc_id")) & (at == F.col("w.first.at"))
    return spans.select("doc_id", is_first.alias("is_first"), at.cast("int").alias("start_word"), (at + min_words + (F.col("times") - 1) * F.col("n")).cast("int").alias("end_word"), F.col("w.first.doc_id").alias("first_doc_id"))


def find_repeats(docs: DataFrame, min_words: int = 50, seed_words: int = 10) -> DataFrame:
    """Spans of words that lie in a run of ``min_words`` words found at another place too.

    docs needs doc_id and text. Returns doc_id, is_first, start_word, end_word (one past the last), n_words,
    first_doc_id (the smallest id among the places of the span's windows). Spans are split where the first occurrence
    ends and a repeat starts.
    """
    if not 0 < seed_words <= min_words:
        raise ValueError("seed_words must lie between 1 and min_words")
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = shared_dir(docs.sparkSession)
    kept = materialise(columns.mapInArrow(_kept_suffixes(min_words, seed_words, common_seeds(columns, seed_words)), _SAMPLES), f"{folder}/kept")
    hot = materialise(kept.groupBy("seed").agg(F.count("*").alias("records")).filter(F.col("records") > HOT).select("seed"), f"{folder}/hot")
    many = not hot.isEmpty()
    calm = kept.join(hot, "seed", "left_anti").select(*kept.columns) if many else kept
    spans = calm.repartition("seed").sortWithinPartitions("seed").mapInArrow(_compared(min_words), _SPANS)
    if many:
        spans = spans.unionByName(_matched_hot(kept.join(hot, "seed", "left_semi"), min_words))
    spans = spans.filter(F.col("doc_id") != _NO_ID)
    own = Window.partitionBy("doc_id", "is_first").orderBy("start_word", "end_word")
    before = F.max("end_word").over(own.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before >= F.col("start_word"), 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return (
        spans.withColumn("island", island)
        .groupBy("doc_id", "is_first", "island")
        .agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("first_doc_id").alias("first_doc_id"))
        .select("doc_id", "is_first", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")
    )


_WORD = re.compile(rb"[^ \t\n\r\x0b\x0c]+")


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of the spans and the blanks before them."""
    ends = [0, *(m.end() for m in _WORD.finditer(text))]  # bytes up to the end of so many words
    out, done = [], 0
    for a, b in sorted(spans):
        if a > done:
            out.append(text[ends[done] : ends[a]])
        done = max(done, b)
    return b"".join([*out, text[ends[done] :]])


def _without(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            columns = dict(zip(names, batch.column("_row").flatten()))
            old = as_bytes(columns["text"])
            spans = [[(s["start_word"], s["end_word"]) for s in own or ()] for own in batch.column("_spans").to_pylist()]
            new = [cut(t, own) if t is not None and own else t for t, own in zip(old, spans)]
            columns["text"] = pa.array(new, pa.binary()).cast(columns["text"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return run


def remove_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the words of every span that is not first cut out of the texts; other columns, of any names, stay."""
    per = spans.filter("not is_first").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("_spans"))
    packed = docs.select(F.struct("*").alias("_row"))  # no name of its own can clash
    joined = packed.join(per, F.col("_row.doc_id") == F.col("_id"), "left").select("_row", "_spans")
    return joined.mapInArrow(_without(docs.columns), docs.schema)

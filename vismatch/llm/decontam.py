"""Benchmark decontamination with suffix arrays of the training texts.

The training texts are cut into shards of bounded size inside the tasks that read them. Each shard gets a suffix array
over its words, once, sorted as deep as the longest window; every suffix of every benchmark item with at least a window's
words is binary-searched in it by its first window, for all items at once. The interval found holds all places of the
window: these are the verbatim matches and their locations. Matches that follow each other on one diagonal join into the
longest match from there, so the common prefix of two suffixes comes out whole; suffixes shorter than a window match
nothing of their own.

The benchmark is the query side. It is read in blocks of bounded size, one at a time on the driver, and each block's
windows, without repeats, are a broadcast of bounded size. A task searches its shard for one block after another and holds
one block's windows at a time, so the texts are scanned once, nothing is shuffled, and a text's matches stay with its row.
A text's items are those of its windows, each window counted once; its longest match is followed from place to place.
Pairs of items and places are only listed where their locations are asked for (``find_matches``).

Words: A-Z lower-cased, then runs of ASCII digits, a-z and non-ASCII characters, compared by 64-bit keys. A window is
``window`` consecutive item words; an item with fewer words, but not none, is one window. Defined cases: null texts have no words; null items
and items without words match nothing; items with a null id are left out; repeated item ids count once; repeated rows of
documents each get a row; windows never cross texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ALNUM_TABLE, Rolling, WordKeys, as_bytes, blocks

#: Words of a shard; one text of more makes a shard of its own.
SHARD_WORDS = 400_000
#: Bytes of benchmark text that are searched at once.
BLOCK_BYTES = 8 << 20
#: Windows that are searched at once.
SEARCHED = 1 << 16
_BITS = 21  # of a word's number or a rank: three fit 63 bits
_keys = WordKeys()


def keys_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words of all texts, and the number of words of each."""
    return _keys.of_texts([(t or b"").translate(ALNUM_TABLE) for t in texts])


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(np.append(0, np.diff(keys[order]) != 0))
    return order, ranks


def suffix_array(numbers: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their next ``depth`` numbers at least; the end is below all numbers. Fewer than 2**31 of them."""
    n = len(numbers)
    if not n:
        return np.zeros(0, np.int64)

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        return np.append(x[by:], np.zeros(min(by, n), np.int64))[:n]

    def tripled(x: np.ndarray, by: int) -> np.ndarray:
        return (x << (2 * _BITS)) | (shifted(x, by) << _BITS) | shifted(x, 2 * by)

    if n < 1 << _BITS and numbers.max() < 1 << _BITS:
        order, ranks = _ranks(tripled(numbers, 1))
        done = 3
        if depth > done:
            order, ranks = _ranks(tripled(ranks + 1, done))
            done = 9
    else:
        order, ranks = _ranks(numbers)
        done = 1
    while done < depth:  # only suffixes that agree so far need what follows
        tied = np.append(False, np.diff(ranks[order]) == 0)
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        keys = (ranks << 32) | shifted(ranks + 1, done)
        rows = order[at]
        order[at] = rows[np.argsort(keys[rows], kind="stable")]
        ranks[order] = np.cumsum(np.append(0, np.diff(keys[order]) != 0))
        done *= 2
    return order


class Windows:
    """The distinct windows of a block of benchmark items, and the items and offsets at which each stands."""

    def __init__(self, items: list[tuple[int, bytes]], window: int) -> None:
        self.words, counts = keys_of([text for _, text in items])
        begins = np.cumsum(counts) - counts
        many = np.where(counts >= window, counts - window + 1, np.minimum(counts, 1))  # windows of each item
        owner = np.repeat(np.arange(len(items)), many)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        start, size = begins[owner] + at, np.minimum(window, counts)[owner]
        rolling = Rolling()
        sums = rolling.prefix(self.words)
        key = (sums[start + size] - sums[start]) * rolling.inverse[start] + size.astype(np.uint64)
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        self.start, self.size = start[first], size[first]
        order = np.argsort(of, kind="stable")
        self.item, self.at = np.array([i for i, _ in items], np.int64)[owner][order], at[order]
        self.where = (start + owner)[order]  # ascending for each window; neighbours differ by 1 in an item, by more across two
        self.pairs = np.searchsorted(of[order], np.arange(len(first) + 1))  # those of each window


def _spread(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, low[row] + 0, 1, ...) for count[row] entries of each row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


class Shard:
    """The suffix array of some texts, and what has been found in each."""

    def __init__(self, texts: list[bytes | None], window: int, located: bool) -> None:
        keys, self.sizes = keys_of(texts)
        self.located, self.longest = located, [0] * len(texts)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.distinct, numbers = np.unique(keys, return_inverse=True)
        self.text = np.zeros(len(keys) + len(texts), np.int64)  # 0 ends each text
        self.text[np.arange(len(keys)) + np.repeat(np.arange(len(texts)), self.sizes)] = numbers + 1
        self.order = suffix_array(self.text, window)
        self.padded = np.append(self.text, np.zeros(window, np.int64))
        self.ranges: list[list[dict]] = [[] for _ in texts]
        self.items: list[set[int]] = [set() for _ in texts]
        self.matches: list[list[dict]] = [[] for _ in texts]

    def _bound(self, rows: np.ndarray, size: np.ndarray, upper: bool) -> np.ndarray:
        """First place in the suffix array at (or, with upper, past) the suffixes that start with each row of numbers."""
        width = rows.shape[1]
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.order), np.int64)
        used = np.arange(width)[None, :] < size[:, None]
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            found = self.padded[self.order[mid][:, None] + np.arange(width)]
            differs = (found != rows[open_]) & used[open_]
            first = differs.argmax(1)
            row = np.arange(len(open_))
            equal = ~differs[row, first]
            less = np.where(equal, upper, found[row, first] < rows[open_, first])
            low[open_[less]], high[open_[~less]] = mid[less] + 1, mid[~less]
        return low

    def search(self, windows: Windows, window: int) -> None:
        """Add the matches of a block's windows."""
        if not len(windows.start) or not len(self.distinct):
            return
        at = np.minimum(np.searchsorted(self.distinct, windows.words), len(self.distinct) - 1)
        numbers = np.where(self.distinct[at] == windows.words, at + 1, 0)  # 0: not in this shard
        missing = np.append(0, np.cumsum(numbers == 0))
        alive = np.flatnonzero(missing[windows.start + windows.size] == missing[windows.start])
        numbers = np.append(numbers, np.zeros(window, np.int64))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, len(alive), SEARCHED):
            own = alive[a : a + SEARCHED]
            rows, size = numbers[windows.start[own][:, None] + np.arange(window)], windows.size[own]
            low, high = self._bound(rows, size, False), self._bound(rows, size, True)
            row, place = _spread(low, high - low)
            found.append((own[row], self.order[place]))
        if found and sum(len(w) for w, _ in found):
            self._keep(windows, *(np.concatenate(x) for x in zip(*found)))

    def _keep(self, windows: Windows, which: np.ndarray, place: np.ndarray) -> None:
        doc = np.searchsorted(self.starts, place, "right") - 1
        by = np.lexsort((place, doc))
        cuts = np.flatnonzero(np.diff(doc[by], prepend=-1))
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(by)).tolist()):
            d = int(doc[by[a]])
            begin = place[by[a:b]] - self.starts[d]
            end = np.maximum.accumulate(begin + windows.size[which[by[a:b]]])
            cut = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
            self.ranges[d] += [{"a": x, "b": y} for x, y in zip(begin[cut].tolist(), end[np.append(cut[1:], b - a) - 1].tolist())]
            self.longest[d] = max(self.longest[d], _longest(windows, which[by[a:b]], begin))
        once = np.unique(doc * np.int64(len(windows.start)) + which)  # each window of a text, however often it stands there
        for d, w in zip((once // len(windows.start)).tolist(), (once % len(windows.start)).tolist()):
            self.items[d].update(windows.item[windows.pairs[w] : windows.pairs[w + 1]].tolist())
        if self.located:
            self._locate(windows, which, place)

    def _locate(self, windows: Windows, which: np.ndarray, place: np.ndarray) -> None:
        """Add the longest matches on each diagonal: as many rows as there are, which is what the caller asks for."""
        row, pair = _spread(windows.pairs[which], windows.pairs[which + 1] - windows.pairs[which])
        item, at, place, size = windows.item[pair], windows.at[pair], place[row], windows.size[which[row]]
        order = np.lexsort((place, place - at, item))
        new = np.append(True, (np.diff(place[order]) != 1) | (np.diff((place - at)[order]) != 0) | (np.diff(item[order]) != 0))
        start = np.flatnonzero(new)
        run = np.diff(np.append(start, len(order))) - 1 + size[order][start]
        first = order[start]
        own = np.searchsorted(self.starts, place[first], "right") - 1
        for d, i, x, y, n in zip(own.tolist(), item[first].tolist(), at[first].tolist(), (place[first] - self.starts[own]).tolist(), run.tolist()):
            self.matches[d].append({"item_id": i, "item_start": x, "start": y, "n_words": n})


def _longest(windows: Windows, which: np.ndarray, begin: np.ndarray) -> int:
    """Words of the longest match of a text whose windows begin at these places, in order. It goes from place to place with
    the items' places that match so far, so a window that many items share costs as many steps at each of its places, and
    never its items times its places at once."""
    size = windows.size[which]
    longest = int(size.max())
    full = np.flatnonzero(size == longest)  # shorter windows are whole items
    before, active, lengths = -2, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for w, place in zip(which[full].tolist(), begin[full].tolist()):
        where = windows.where[windows.pairs[w] : windows.pairs[w + 1]]
        if place == before + 1:
            at = np.minimum(np.searchsorted(active, where - 1), len(active) - 1)
            lengths = np.where(active[at] == where - 1, lengths[at] + 1, 1)
        else:
            lengths = np.ones(len(where), np.int64)
        before, active = place, where
        longest = max(longest, int(size[full[0]]) - 1 + int(lengths.max()))
    return longest


def benchmark_blocks(benchmark: DataFrame, window: int, block_bytes: int = BLOCK_BYTES) -> list[Broadcast]:
    """Broadcasts of the windows of items whose texts hold ``block_bytes`` at most (or one item), made one at a time."""
    if window < 1:
        raise ValueError("a window has at least one word")
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    out: list[Broadcast] = []
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            out.append(benchmark.sparkSession.sparkContext.broadcast(Windows(held, window)))
        held, size = [], 0

    for row in items.toLocalIterator():
        text = row["text"].encode()
        if size + len(text) > block_bytes:
            flush()
        held.append((row["item_id"], text))
        size += len(text)
    flush()
    return out


def _value(block: Broadcast, several: bool) -> Windows:
    """A block's windows. Of several blocks a worker holds one at a time; the next shard loads it from the broadcast's file."""
    value = block.value
    if several:
        block.__dict__.pop("_value", None)
    return value


def _searched(blocks_: list[Broadcast], window: int, located: bool = False):
    """Batches of rows with the shard of their texts, searched for all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Shard]]:
        def done(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, Shard]:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            shard = Shard(as_bytes(table.column("text")), window, located)
            for block in blocks_:
                shard.search(_value(block, len(blocks_) > 1), window)
            return table, shard

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in blocks(batches, 64):
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= 6 * SHARD_WORDS:  # bytes; a word with its blank has about six
                yield done(held)
                held, size = [], 0
        if held:
            yield done(held)

    return run


_MATCH = "struct<item_id:long,item_start:int,start:int,n_words:int>"
_FOUND = f"doc_id long, n_words long, ranges array<struct<a:int,b:int>>, items array<long>, matches array<{_MATCH}>"


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each document: its words, ranges of words inside matches, the items found and the longest verbatim matches with
    their places in item and document."""
    search = _searched(benchmark_blocks(benchmark, window, block_bytes), window, located=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = pa.int32()
        kinds = [pa.int64(), pa.list_(pa.struct([("a", small), ("b", small)])), pa.list_(pa.int64()), pa.list_(pa.struct([("item_id", pa.int64()), ("item_start", small), ("start", small), ("n_words", small)]))]
        for batch, shard in search(batches):
            found = (shard.sizes.tolist(), shard.ranges, [sorted(x) for x in shard.items], shard.matches)
            yield pa.record_batch([batch.column("doc_id"), *map(pa.array, found, kinds)], names=["doc_id", "n_words", "ranges", "items", "matches"])

    return _columns(docs).mapInArrow(run, _FOUND)


def match_locations(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each longest verbatim match: doc_id, item_id, and its first word in the item and in the document, n_words."""
    return find_matches(docs, benchmark, window, block_bytes).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _n_hit(ranges: list[dict]) -> int:
    total = end = 0
    for r in sorted(ranges, key=lambda r: r["a"]):
        total += max(0, r["b"] - max(r["a"], end))
        end = max(end, r["b"])
    return total


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: words, hit words, number and digest of the items found, verdict, longest match."""
    search = _searched(benchmark_blocks(benchmark, window, block_bytes), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, shard in search(batches):
            hits, names = [_n_hit(r) for r in shard.ranges], [sorted(map(str, x)) for x in shard.items]
            yield pa.record_batch(
                [
                    batch.column("doc_id"), pa.array(shard.sizes), pa.array(hits, pa.int64()), pa.array([len(x) for x in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), pa.array([h > 0 for h in hits], pa.bool_()), pa.array(shard.longest, pa.int64()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match"],
            )

    return _columns(docs).mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a window of the benchmark, with all their columns."""
    search = _searched(benchmark_blocks(benchmark, window, block_bytes), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, shard in search(batches):
            yield batch.filter(pa.array([not x for x in shard.ranges], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""SimHash near-duplicate components by the general pigeonhole principle.

Fingerprints: A-Z lower-cased, words, 3-word shingles with repeats (fewer words: the whole sequence; none: zero), XXH64
with seed 42; a bit is 1 if set in over half the hashes.

Search on distinct fingerprints, so copies cost nothing further:

1. On a bounded sample of fingerprints the correlations of the 64 bits are estimated and correlated bits are grouped
   into m partitions (m = 2, 3, 4). If thresholds t_1..t_m add up to r - m + 1, two fingerprints within r bits agree
   to within t_i bits in some partition i (t_i = -1 leaves a partition out). For each m a dynamic program over the
   partitions chooses the thresholds with the least estimated number of candidates; the cheapest m is taken.
2. Each fingerprint is probed under keys: its bits in a partition with each choice of t_i bits blanked. Fingerprints
   that agree to within t_i bits share a key.
3. A key of more than ``LEAF`` members is divided before anything is shuffled to it: the pigeonhole is applied again to
   the bits that its members may differ in, with the same guarantee, until keys are small or few bits are left. Inside
   a key, candidates are verified in blocks and only links that join two so far unconnected fingerprints are emitted: at
   most one fewer than the key's members, never all pairs.
4. Components by alternating large and small star steps over Spark joins, each written to the shared folder.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows each get a row; a null
document id never names a component unless all its members are null; extra columns do not matter. ``keep_one`` keeps
exactly one row of each component, also where ids are null or repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import as_bytes, blocks, drop, materialise, shared_dir

RADIUS = 3
SHINGLE = 3
#: Fingerprints on which correlations and candidate counts are estimated.
SAMPLE = 20_000
#: Members of a key that are compared with each other at once.
LEAF = 4_096
_xxh64 = partial(xxhash.xxh64_intdigest, seed=42)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        out = np.zeros(batch.num_rows, np.uint64)
        for row, text in enumerate(as_bytes(batch.column("text"))):
            words = (text or b"").lower().split()
            if not words:
                continue
            joined = b" ".join(words)
            if len(words) <= SHINGLE:
                out[row] = _xxh64(joined)
                continue
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.append(0, ends[:-1] + 1)
            slices = map(slice, starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())
            n = len(words) - SHINGLE + 1
            hashes = np.fromiter(map(_xxh64, map(joined.__getitem__, slices)), np.uint64, n)
            out[row] = np.packbits(2 * _bit_counts(hashes) > n, bitorder="little").view(np.uint64)[0]
        others = [n for n in batch.schema.names if n not in ("doc_id", "text")]
        yield pa.record_batch([batch.column("doc_id"), out.view(np.int64), *map(batch.column, others)], names=["doc_id", "fp", *others])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 128):  # below 256, so that bytes can count
        bits = np.unpackbits(hashes[at : at + 128].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.uint8)
    return total


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(_fingerprints, "doc_id long, fp long")


# --- choice of partitions and thresholds


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m groups of equal size: each grows by the bit most correlated with its members."""
    spread = bits.astype(np.float64) - bits.mean(0) if len(bits) else np.zeros((1, 64))
    scale = np.sqrt((spread**2).sum(0))
    scale[scale == 0] = 1
    related = np.abs((spread / scale).T @ (spread / scale))
    free, groups = set(range(64)), []
    for i in range(m):
        size = (64 - sum(map(len, groups))) // (m - i)
        first = min(free)
        own = [first]
        free.discard(first)
        while len(own) < size:
            best = max(sorted(free), key=lambda b: related[b, own].sum())
            own.append(best)
            free.discard(best)
        groups.append(sorted(own))
    return groups


def _compact(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    mask = np.uint64(sum(1 << b for b in bits))
    return fps & mask


def _estimate(sample: np.ndarray, bits: list[int], t: int, rows: int) -> float:
    """Estimated cost of a partition at threshold t: keys to write, and pairs that share one in all rows."""
    if t < 0:
        return 0.0
    w, n = len(bits), max(len(sample), 2)
    values = _compact(sample, bits)
    pairs = 0.0
    blanks = list(combinations(bits, t))
    tried = blanks if len(blanks) <= 64 else blanks[:: len(blanks) // 64]
    for blank in tried:
        _, count = np.unique(values & ~np.uint64(sum(1 << b for b in blank)), return_counts=True)
        pairs += float((count * (count - 1.0)).sum()) / 2
    pairs = pairs * len(blanks) / len(tried) * (rows / n) ** 2
    floor = rows**2 / 2.0 ** (w - t + 1) * len(blanks)  # what a sample without collisions can't show
    return 200.0 * comb(w, t) * rows + max(pairs, floor)


def choose(sample: np.ndarray, rows: int, radius: int = RADIUS, sizes: tuple[int, ...] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """Partitions and thresholds of the least estimated cost."""
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in sizes:
        groups = group_bits(bits_of(sample), m)
        goal = radius - m + 1
        # state: sum of (t + 1) so far -> (cost, thresholds)
        states: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for bits in groups:
            cost = {t: _estimate(sample, bits, t, rows) for t in range(-1, goal + m if goal + m < 3 else 3)}
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (c, ts) in states.items():
                for t, more in cost.items():
                    if used + t + 1 <= goal + m and (now := c + more) < after.get(used + t + 1, (np.inf, ()))[0]:
                        after[used + t + 1] = (now, (*ts, t))
            states = after
        if goal + m in states and (best is None or states[goal + m][0] < best[0]):
            cost, ts = states[goal + m]
            best = cost, [(bits, t) for bits, t in zip(groups, ts) if t >= 0]
    return best[1]


# --- probing and verification


def _masks(chosen: list[tuple[list[int], int]]) -> list[int]:
    out = []
    for bits, t in chosen:
        whole = sum(1 << b for b in bits)
        out += [whole & ~sum(1 << b for b in blank) for blank in combinations(bits, t)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _leaf_links(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the graph 'within radius': each fingerprint is compared once with those not yet reached."""
    left = np.arange(len(fps))
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            x = reached.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= radius
            if near.any():
                found = left[near].tolist()
                left = left[~near]
                reached += found
                for y in found:
                    yield x, y


def spanning_links(fps: np.ndarray, free: int = (1 << 64) - 1, radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """As _leaf_links, but large sets are divided first, by the plain pigeonhole on the bits in which they may differ."""
    bits = [b for b in range(64) if free >> b & 1]
    if len(fps) <= LEAF or len(bits) <= 4 * (radius + 1):
        yield from _leaf_links(fps, radius)
        return
    forest = _Forest(len(fps))
    for part in range(radius + 1):
        own = bits[part :: radius + 1]
        mask = sum(1 << b for b in own)
        values = fps & np.uint64(mask)
        order = np.argsort(values, kind="stable")
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(values[order]) != 0)), len(order))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a > 1:
                rows = order[a:b]
                for x, y in spanning_links(fps[rows], free & ~mask, radius):
                    if forest.join(int(rows[x]), int(rows[y])):
                        yield int(rows[x]), int(rows[y])


def _linked(free: list[int], radius: int):
    """Links inside each key; free: by kind of key, the bits in which its members may differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key: tuple[int, int] | None = None

        def flush() -> pa.RecordBatch | None:
            fps = np.unique(np.concatenate(held)).view(np.uint64)
            pairs = list(spanning_links(fps, free[key[0]], radius)) if len(fps) > 1 else []
            if not pairs:
                return None
            a, b = np.ascontiguousarray(fps.view(np.int64)[np.array(pairs)].T)
            return pa.record_batch([np.minimum(a, b), np.maximum(a, b)], names=["a", "b"])

        for batch in batches:
            part, value, fp = (batch.column(c).to_numpy() for c in ("part", "value", "fp"))
            cuts = np.append(np.flatnonzero(np.append(True, (np.diff(part) != 0) | (np.diff(value) != 0))), len(fp)) if len(fp) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                now = int(part[a]), int(value[a])
                if now != key:
                    if held and sum(map(len, held)) > 1 and (out := flush()):
                        yield out
                    key, held = now, []
                held.append(fp[a:b])
        if held and (out := flush()):
            yield out

    return run


def _keyed(rows: DataFrame, masks: list[tuple[int, int]], *more: str) -> DataFrame:
    """A row for each fingerprint and (part, mask): part, value, fp."""
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for i, m in masks])
    return rows.select("fp", *more, F.explode(keys).alias("k")).select("k.part", "k.value", "fp")


def link_fingerprints(distinct: DataFrame, chosen: list[tuple[list[int], int]], folder: str, radius: int = RADIUS) -> DataFrame:
    """Links a < b that connect all fingerprints (column fp, distinct) within radius of each other."""
    masks = _masks(chosen)
    free = [((1 << 64) - 1) & ~m for m in masks]
    probes = _keyed(distinct, list(enumerate(masks)))
    for level in range(8):
        large = materialise(probes.groupBy("part", "value").agg(F.count("*").alias("n")).filter(F.col("n") > LEAF).select("part", "value"), f"{folder}/large{level}")
        parts = [r["part"] for r in large.select("part").distinct().collect() if free[r["part"]].bit_count() > 4 * (radius + 1)]
        if not parts:
            break
        large = large.filter(F.col("part").isin(parts))
        divided = probes.join(large, ["part", "value"], "left_semi")
        rest, now = probes.join(large, ["part", "value"], "left_anti"), []
        for part in parts:
            bits = [b for b in range(64) if free[part] >> b & 1]
            new = []
            for i in range(radius + 1):
                own = sum(1 << b for b in bits[i :: radius + 1])
                new.append((len(masks), masks[part] | own))
                masks.append(masks[part] | own)
                free.append(free[part] & ~own)
            now.append(_keyed(divided.filter(F.col("part") == part).select("fp"), new))
        probes = materialise(reduce(DataFrame.unionByName, now, rest), f"{folder}/probes{level}")
    dealt = probes.repartition("part", "value").sortWithinPartitions("part", "value")
    return dealt.mapInArrow(_linked(free, radius), "a long, b long").distinct()


def components(links: DataFrame, folder: str, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of links, by large-star and small-star steps."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{folder}/round0")
    before = None
    for round_ in range(1, most_rounds + 1):
        # large star: of each node's neighbours, the larger ones are tied to the smallest (itself included)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: each node and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{folder}/round{round_}")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        drop(links.sparkSession, f"{folder}/round{round_ - 1}")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _labelled(fps: DataFrame, folder: str, radius: int) -> DataFrame:
    """fp, component (a fingerprint of it) and component_id (its smallest id) for each distinct fingerprint of (doc_id, fp)."""
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{folder}/distinct")
    rows = distinct.count()
    sample = distinct.sample(min(1.0, SAMPLE / max(rows, 1)), 11).select("fp").limit(2 * SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    links = link_fingerprints(distinct.select("fp"), choose(sample, rows, radius), folder, radius)
    own = components(links, folder).join(distinct.withColumnRenamed("fp", "node"), "node")
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = own.join(least, "component").select(F.col("node").alias("fp"), "component", "component_id")
    every = distinct.join(labels, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "least").alias("component_id"))
    return materialise(every, f"{folder}/labels")  # a join of its own, whose hot fingerprints Spark can split


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable) for each row of docs."""
    folder = shared_dir(docs.sparkSession)
    fps = materialise(fingerprints(docs), f"{folder}/fingerprints")
    every = _labelled(fps, folder, radius)
    return fps.join(every, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _row_key(doc_id: Column, text: Column) -> Column:
    """A text that two rows share only if they have the same id and equal texts, up to a hash within the id."""
    return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(F.xxhash64(text).cast("string"), F.lit("")), F.length(text).cast("string"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component, with all columns of docs: the one with the smallest id, ids before null; of rows that
    share it the one whose text hashes lowest; of equal rows any one."""
    folder = shared_dir(docs.sparkSession)
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    columns = docs.select(doc_id.alias("doc_id"), text.alias("text"), _row_key(doc_id, text).alias("row"))
    fps = materialise(columns.mapInArrow(_fingerprints, "doc_id long, fp long, row string"), f"{folder}/fingerprints")
    choice = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = fps.join(_labelled(fps, folder, radius), "fp").groupBy("component").agg(choice.alias("best")).select(F.col("best.row").alias("_kept"))
    kept = materialise(kept, f"{folder}/kept")
    packed = docs.select(F.struct("*").alias("_row"))  # no name of its own can clash
    keyed = packed.withColumn("_kept", _row_key(F.col("_row.doc_id").cast("long"), F.col("_row.text").cast("string")))
    first = F.row_number().over(Window.partitionBy("_kept").orderBy("_kept"))
    return keyed.join(kept, "_kept", "left_semi").withColumn("_first", first).filter("_first = 1").select("_row.*")

"""Benchmarks whose items share windows, and benchmarks of many blocks."""

import random
import time

import pytest

from vismatch.llm import decontam


def longest(text, items, window):
    """Longest run of words of at least a window (or a whole shorter item) that text and an item share."""
    best = 0
    for item in items:
        if 0 < len(item) < window:
            best = max(best, len(item) if any(text[i : i + len(item)] == item for i in range(len(text))) else 0)
            continue
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n]:
                    n += 1
                best = max(best, n if n >= window else 0)
    return best


@pytest.mark.parametrize("located", [False, True])
def test_longest_matches_are_those_of_brute_force(located):
    rng = random.Random(1)
    for case in range(60):
        window = rng.choice([1, 2, 3])
        items = [[rng.choice("ab") for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(1, 5))]
        texts = [[rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(3)]
        shard = decontam.Shard([" ".join(t).encode() for t in texts], window, located)
        shard.search(decontam.Windows([(i, " ".join(x).encode()) for i, x in enumerate(items)], window), window)
        assert shard.longest == [longest(t, items, window) for t in texts]
        assert not located or [max((m["n_words"] for m in own), default=0) for own in shard.matches] == shard.longest
        starts = [{tuple(x[i : i + min(window, len(x))]) for i in range(max(1, len(x) - window + 1))} if x else set() for x in items]
        for t, found in zip(texts, shard.items):
            assert found == {n for n, own in enumerate(starts) if any(tuple(t[i : i + len(w)]) == w for w in own for i in range(len(t)))}


def test_a_window_that_many_items_share():
    prompt = "answer the question below by one of the letters that follow"
    items = [(i, f"{prompt} q{i} w{i}".encode()) for i in range(3_000)]
    texts = [" x ".join([prompt] * 3_000).encode()]
    began = time.perf_counter()
    shard = decontam.Shard(texts, 10, False)
    shard.search(decontam.Windows(items, 10), 10)
    assert time.perf_counter() - began < 5 and len(shard.items[0]) == 3_000 and shard.longest == [11]
    assert decontam._n_hit(shard.ranges[0]) == 11 * 3_000


def test_a_worker_holds_one_block_at_a_time(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(50)]
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    blocks = decontam.benchmark_blocks(benchmark, 10, block_bytes=1)
    assert len(blocks) == 50
    assert all(len(decontam._value(b, True).words) == 30 and "_value" not in vars(b) for b in blocks)
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in rows[:3]] + [(9, "clean")], "doc_id long, text string")
    found = {r.doc_id: (r.n_items, r.longest_match) for r in decontam.contamination_report(docs, benchmark, block_bytes=1).collect()}
    assert found == {0: (1, 30), 1: (1, 30), 2: (1, 30), 9: (0, 0)}

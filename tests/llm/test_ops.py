"""The training-data operators against SQL, brute force, round trips and held-out figures; and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from compare import same
from vismatch.llm._common import WordKeys
from vismatch.llm import decontam, licenses, lm_score, mixing, pii, quality, queries, simhash, suffix_dedup, token_files, warc

TOKENIZER = queries.tokenizer_file()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, data, name):
    same(spark, data, queries.queries()[name], queries.oracle_sql()[name])


def words(text):
    return (text or "").encode().split()


# --- 1


def repeated_words(rows, size):
    places = defaultdict(list)
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - size + 1):
            places[tuple(w[i : i + size])].append((doc, i))
    return {(d, k) for own in places.values() if len(own) > 1 for d, i in own for k in range(i, i + size)}


def repeated_spans(rows, size):
    """All columns of the result by brute force, for distinct ids (null ids are places after all others)."""
    last = lambda d: (d is None, d or 0)
    places = defaultdict(list)
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - size + 1):
            places[tuple(w[i : i + size])].append((last(doc), i))
    windows = defaultdict(dict)
    for own in places.values():
        first = min(own)
        for place in own if len(own) > 1 else ():
            windows[place[0], place == first][place[1]] = first[0]
    out = set()
    for (doc, is_first), at in windows.items():
        starts = sorted(at)
        cuts = [0, *(i for i in range(1, len(starts)) if starts[i] > starts[i - 1] + size), len(starts)]
        for a, b in zip(cuts, cuts[1:]):
            own = starts[a:b]
            if not doc[0]:
                out.add((doc[1], is_first, own[0], own[-1] + size, own[-1] + size - own[0], min(at[i] for i in own)[1]))
    return out


def found_words(spans):
    return {(r.doc_id, k) for r in spans for k in range(r.start_word, r.end_word)}


@pytest.mark.parametrize("share,hot", [(1 / 5_000, 200_000), (1e-6, 3), (1 / 5_000, 0)])
def test_spans_are_those_of_brute_force(spark, docs, monkeypatch, share, hot):
    monkeypatch.setattr(suffix_dedup, "COMMON_SHARE", share)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = suffix_dedup.find_repeats(docs).collect()
    assert found_words(found) == repeated_words(rows, 50)
    assert {tuple(r) for r in found} == repeated_spans(rows, 50) and len(found) == len(set(found))


def test_spans_on_odd_tables(spark, odd, empty):
    spans = suffix_dedup.find_repeats(odd, 50, 10).collect()
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert found_words(spans) == {w for w in repeated_words(rows, 50) if w[0] is not None}
    assert {tuple(r) for r in spans} == repeated_spans(rows, 50)
    assert {r.first_doc_id for r in spans if r.doc_id == 2} == {1, 2}  # 2's own end repeats in its second row only
    assert suffix_dedup.find_repeats(empty).count() == 0


def test_small_windows_and_periods(spark, monkeypatch):
    texts = ["a b " * 40, "x a b a b a b y", "a b c d e f g h i j", "q a b c d e f r", None]
    rows = [*enumerate(texts), (None, "y y y a b c d e f r z"), (None, "only null rows have this text here"), (None, "only null rows have this text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (200_000, 1):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        assert {tuple(r) for r in suffix_dedup.find_repeats(docs, 6, 3).collect()} == repeated_spans(rows, 6)


def test_repeats_are_cut_out(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    docs = spark.createDataFrame([(1, f"one {passage} two", 7), (2, f"three\n{passage}  four ", None), (3, "clean", 1), (None, None, 2)], "doc_id long, text string, spans int")
    made = suffix_dedup.remove_repeats(docs, suffix_dedup.find_repeats(docs))
    cut = {r.doc_id: (r.text, r.spans) for r in made.collect()}
    assert made.columns == docs.columns
    assert cut == {1: (f"one {passage} two", 7), 2: ("three  four ", None), 3: ("clean", 1), None: (None, 2)}


def test_cutting_words():
    text = b"  a b\tc\n d "
    assert [suffix_dedup.cut(text, s) for s in ([], [(0, 1)], [(1, 3)], [(2, 4), (0, 1), (2, 3)], [(0, 4)])] == [text, b" b\tc\n d ", b"  a\n d ", b" b ", b" "]
    long_ = b"word " * 200_000
    assert suffix_dedup.cut(long_, [(1, 199_999)]) == b"word word "


# --- 2


def test_cascade_order_does_not_change_verdicts(spark, docs):
    ordered = quality.order_rules(docs)
    assert sorted(r.name for r in ordered) == sorted(r.name for r in quality.RULES)
    kept = {r.doc_id for r in quality.filter_documents(docs, ordered).collect()}
    assert kept == {r.doc_id for r in quality.filter_documents(docs, ordered[::-1]).collect()}
    assert kept == {r.doc_id for r in quality.judge_documents(docs, ordered).filter("kept").collect()}


def test_good_documents_are_kept(spark, docs, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    judged = quality.judge_documents(docs, quality.RULES).join(labels, "doc_id").filter("not base_failed")
    good, bad = judged.filter("quality = 1"), judged.filter("quality = 0")
    assert good.filter("kept").count() >= 0.98 * good.count()
    assert bad.filter("not kept").count() >= 0.8 * bad.count()


def test_quality_on_odd_tables(spark, odd, empty):
    judged = quality.judge_documents(odd, quality.order_rules(odd))
    assert judged.count() == odd.count() and judged.filter("doc_id = 3").first().n_words == 0
    assert not quality.filter_documents(odd, quality.RULES).filter("doc_id in (3, 4, 7, 8, 11)").count()
    assert quality.filter_documents(odd, quality.RULES).columns == odd.columns
    assert quality.judge_documents(empty, quality.order_rules(empty)).count() == 0


# --- 3


def report(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_blocks_of_the_benchmark_agree(spark, docs, data):
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    whole = report(decontam.contamination_report(docs, benchmark))
    assert whole == report(decontam.contamination_report(docs, benchmark, block_bytes=2_000))
    clean = {r.doc_id for r in decontam.remove_contaminated(docs, benchmark, block_bytes=2_000).collect()}
    assert clean == {r[0] for r in whole if not r[5]} and len(clean) < len(whole)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for numbers in (rng.integers(1, 4, 500), np.ones(300, np.int64), rng.integers(1, 1 << 21, 50), np.array([1 << 40, 3, 1 << 40, 3])):
        for depth in (1, 3, 10, 18, 60):
            order = decontam.suffix_array(numbers.astype(np.int64), depth)
            keys = [tuple(np.append(numbers[i : i + depth], [0] * depth)[:depth]) for i in order]
            assert keys == sorted(keys) and sorted(order) == list(range(len(numbers)))


def matches_of(docs, items, window):
    """Longest verbatim matches by brute force, and the words that each document has inside windows."""
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found, hits = set(), Counter()
    for d, text in docs:
        w, hit = tokens(text), set()
        for i, item in items:
            v = tokens(item)
            size = min(window, len(v))
            for x in range(len(v) - size + 1 if v else 0):
                for y in range(len(w) - size + 1):
                    if v[x : x + size] == w[y : y + size]:
                        hit |= set(range(y, y + size))
                        if x and y and v[x - 1] == w[y - 1] and v[x - 1 : x - 1 + size] == w[y - 1 : y - 1 + size]:
                            continue
                        n = size
                        while x + n < len(v) and y + n < len(w) and v[x + n] == w[y + n]:
                            n += 1
                        found.add((d, i, x, y, n))
        hits[d] = len(hit)
    return found, hits


@pytest.mark.parametrize("window", [1, 4, 25])
def test_matches_are_those_of_brute_force(spark, monkeypatch, window):
    rng = random.Random(window)
    word = lambda: rng.choice(["a", "B", "c,", "\u00e9", "d"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(40)))) for i in range(12)] + [(99, " ".join("abc"[k % 3] for k in range(60)))]
    docs = [(d, " ".join(word() for _ in range(rng.randrange(30))) + " " + rng.choice(items)[1] + " z " + rng.choice(items)[1][:50]) for d in range(40)]
    monkeypatch.setattr(decontam, "SEARCHED", 7)
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want, hits = matches_of(docs, items, window)
    for size in (8 << 20, 60):
        assert {tuple(r) for r in decontam.match_locations(*frames, window, size).collect()} == want
    assert {r.doc_id: r.n_hit for r in decontam.contamination_report(*frames, window).collect()} == hits


def test_decontamination_on_odd_tables(spark, odd, empty):
    benchmark = spark.createDataFrame([(1, "p1 p2 p3"), (2, None), (None, "p1"), (3, ""), (1, "word"), (4, " ".join(f"P{i}" for i in range(20, 40)))], "item_id long, text string")
    found = {(r.doc_id, r.n_hit, r.n_items, r.longest_match) for r in decontam.contamination_report(odd, benchmark).collect()}
    assert {(1, 23, 2, 20), (11, 1, 1, 1), (3, 0, 0, 0), (None, 23, 2, 20), (None, 0, 0, 0)} <= found
    none = hashlib.sha256(b"").hexdigest()
    assert {r.items_sha256 for r in decontam.contamination_report(odd, benchmark.limit(0)).collect()} == {none}
    assert report(decontam.contamination_report(odd.repartition(3), benchmark, block_bytes=1)) == report(decontam.contamination_report(odd, benchmark))
    with pytest.raises(ValueError):
        decontam.find_matches(odd, benchmark, window=0)
    assert decontam.contamination_report(empty, benchmark).count() == 0


# --- 4


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=3):
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                up[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_simhash_agrees_with_brute_force(spark, docs):
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    of = brute_components({f for _, f in rows})
    least = {c: min(d for d, f in rows if of[f] == c) for c in set(of.values())}
    want = sorted((d, f"{f:016x}", least[of[f]]) for d, f in rows)
    assert sorted(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    assert len({w[2] for w in want}) < len(want)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == set(least.values())


def test_one_row_of_each_component_stays(spark):
    a, b, c = ("alpha beta gamma delta " * 9, "one two three four five " * 7, "x y z w v u " * 8)
    rows = [(None, a), (None, b), (None, a), (5, a), (5, c), (1, c), (5, c), (7, None), (8, ""), (None, None)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _kept int")
    of = lambda t: fingerprint(t)
    assert len({of(t) for t in (a, b, c, "")}) == len(set(brute_components({of(t) for t in (a, b, c, "")}).values())) == 4
    found = simhash.keep_one(docs)
    assert found.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=str) == sorted([(5, a), (None, b), (1, c), (7, None)], key=str)


def test_large_keys_are_divided(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(3)
    centre = np.uint64(0x0123456789ABCDEF)
    near = centre ^ (np.uint64(1) << rng.integers(0, 64, (400, 6)).astype(np.uint64)).sum(1, dtype=np.uint64)
    fps = np.unique(np.concatenate([near, rng.integers(0, 1 << 63, 300).astype(np.uint64)]))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    want = len(set(brute_components(fps.tolist()).values()))
    for leaf in (4_096, 20):
        monkeypatch.setattr(simhash, "LEAF", leaf)
        links = simhash.link_fingerprints(table, simhash.choose(fps, len(fps)), str(tmp_path / str(leaf)))
        pairs = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in links.collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
        up = {int(f): int(f) for f in fps}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for x, y in pairs:
            up[root(x)] = root(y)
        assert len({root(x) for x in up}) == want


@pytest.mark.parametrize("leaf", [4_096, 16])
def test_links_connect_the_same_sets(spark, monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, (60, 3)).astype(np.uint64)).sum(1, dtype=np.uint64) for c in centres]))
    want = brute_components(fps.tolist())
    up = {int(f): int(f) for f in fps}
    for sizes in ((2,), (3,), (4,)):
        chosen = simhash.choose(fps, len(fps), sizes=sizes)
        assert sum(t + 1 for _, t in chosen) == 4
        masks = simhash._masks(chosen)
        links = []
        for mask in masks:
            values = fps & np.uint64(mask)
            for v in np.unique(values):
                own = fps[values == v]
                links += [(int(own[a]), int(own[b])) for a, b in simhash.spanning_links(own, ((1 << 64) - 1) & ~mask)]
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        up = {f: f for f in up}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            up[root(a)] = root(b)
        assert len({root(f) for f in up}) == len(set(want.values()))


def test_simhash_on_odd_tables(spark, odd, empty):
    found = simhash.near_duplicates(odd)
    rows = found.collect()
    assert len(rows) == odd.count()
    zero = {r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert zero == {3} and {r.component_id for r in rows if r.doc_id == 2} == {2}
    kept = [r.doc_id for r in simhash.keep_one(odd).collect()]
    assert kept.count(2) == 1 and 3 in kept and 4 not in kept and simhash.keep_one(odd).columns == odd.columns
    assert simhash.near_duplicates(empty).count() == 0


# --- 5


def targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, free = {}, float(sum(sizes.values())), set(names)
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        free -= over


def check_mix(docs):
    rows = [(r.doc_id, r.source, len(words(r.text))) for r in docs.select("doc_id", "source", "text").collect()]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = targets(sizes)
    found = mixing.mix_report(docs, bucket_rows=20).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((d, n) for d, _, n in rows)
    source = {d: s for d, s, _ in rows}
    taken = Counter()
    for r in found:
        assert 0 <= r.taken <= 3 * r.size and (r.taken == 0) == (r.position is None)
        if r.doc_id is not None:
            assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
            assert r.position is None or 0 <= r.position < 1
            taken[source[r.doc_id]] += r.taken
    return taken, want, found


def test_mix_meets_its_targets(spark, docs):
    taken, want, found = check_mix(docs)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix_report(docs.repartition(7), bucket_rows=20).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_mixed_documents_follow_the_report(spark, docs):
    words_ = sum(len(words(r.text)) for r in docs.select("text").collect())
    mixed = mixing.mix_documents(docs, bucket_rows=20)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.select("text").collect()) == pytest.approx(words_, rel=0.05)
    copies = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    for r in mixing.mix_report(docs, bucket_rows=20).collect():
        assert copies[r.doc_id] <= 3 and abs(copies[r.doc_id] * r.size - r.taken) <= r.size / 2 + 1


def test_positions_invert_the_demand(spark):
    rows = spark.range(0, 100).select((F.col("id") / 100.0).alias("u"))
    for no, knots in enumerate(mixing.SCHEDULES):
        got = [r[1] for r in rows.select("u", mixing.position(F.col("u"), F.lit(1.0), F.lit(no))).orderBy("u").collect()]
        t = np.linspace(0, 1, 20_001)
        demand = np.concatenate([[0], np.cumsum(np.interp((t[1:] + t[:-1]) / 2, *zip(*knots)))]) / 20_000
        want = np.interp(np.arange(100) / 100 * demand[-1], demand, t)
        assert np.allclose(got, want, atol=1e-3)


def test_mixing_on_odd_tables(spark, odd, empty):
    check_mix(odd)
    assert mixing.mix_documents(odd).columns == odd.columns
    assert mixing.mix_report(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


# --- 6


def check_tokens(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.token_index(docs, TOKENIZER).collect())
    want = [(d, [*tokenizer.encode(t, add_special_tokens=False).ids, 2]) for d, t in rows]
    assert [f[1] for f in found] == [d for d, _ in want]
    assert [f[0] for f in found] == list(np.cumsum([0, *(f[2] for f in found)])[:-1])
    key = lambda d, n, c: (str(d), n, c)
    assert sorted(key(*f[1:]) for f in found) == sorted(key(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want)


def test_token_files_round_trip(docs):
    check_tokens(docs)


@pytest.mark.parametrize("slots,at_once", [(1 << 22, 1 << 20), (1 << 10, 40)])
def test_ids_are_those_of_the_library(monkeypatch, slots, at_once):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files._Remembered, "SLOTS", slots)  # begins anew many times
    monkeypatch.setattr(token_files.Tokens, "AT_ONCE", at_once)
    monkeypatch.setattr(token_files.Tokens, "PLAIN", 5)
    library, own, rng = Tokenizer.from_file(TOKENIZER), token_files.Tokens(TOKENIZER), random.Random(5)
    letters = "ab C's'll 1\u00b2\u00bd\u2167_-.!\n\t\r\x1c\x1f\x85\u00a0\u3000\u00e9\u6f22\u5b57\u0663\u0301\u2019' "
    pieces = ["the ", "word", "<|endoftext|>", " ", "\n", "x" * 70 + " ", "\u00e9", "a b c ", "it's, ", "end.\nNext "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(4_000)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(1_000)]
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        assert [x.tolist() for x in own.of([t.encode() for t in some])] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_added_tokens_have_their_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "word<|endoftext|>word <|endoftext|><|endoftext|>\n", "a <|endoftext| > b", "none of them", "a <|ENDOFTEXT|> b"]
    want = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert want[0] == [64, 220, 50256, 275, 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = token_files.token_index(docs, TOKENIZER).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.ids_crc32) for r in found] == [(len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in want]
    assert [r.start for r in found] == list(np.cumsum([0, *map(len, want)])[:-1])


def test_token_files_on_odd_tables(odd, empty):
    check_tokens(odd)
    assert token_files.token_index(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 16_384, 65_536, 70_001])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000)
    coder = token_files.Coder(token_files.scaled(np.bincount(np.append(ids, 7), minlength=50_257)))
    payload = coder.encode(ids)
    assert (coder.decode(payload) == ids).all()
    if n > 16_000:  # the last word of the stream is wrong
        with pytest.raises((ValueError, IndexError)):
            coder.decode(payload[:-4] + bytes(4))


# --- 7


def best_region(text, template, shingle=5, room=1.25):
    """(distinct shingles of the template, first word, words) of the best region of a text, compared word by word."""
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda w: [tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)]
    own, found, best = set(runs(tokens(template))), runs(tokens(text)), (0, 0, 0)
    reach = int(len(tokens(template)) * room) - shingle + 1
    hits = [i for i, s in enumerate(found) if s in own]
    for last in hits:
        inside = [i for i in hits if i <= last and last - i < reach]
        n = len({found[i] for i in inside})
        if n > best[0]:
            best = n, inside[0], last - inside[0] + shingle
    return best, len(own)


def test_licenses_agree_with_brute_force(spark, docs):
    want = set()
    for r in docs.select("doc_id", "text").collect():
        for name, template in licenses.TEMPLATES.items():
            (n, at, size), of = best_region(r.text, template)
            if n >= 0.8 * of:
                want.add((r.doc_id, name, round(n / of, 9), at, size))
    found = {(r.doc_id, r.license, round(r.containment, 9), r.start_word, r.n_words) for r in licenses.scan_licenses(docs).collect()}
    assert found == want and want


def test_damaged_licenses_are_found_and_others_not(spark, odd, empty):
    rng = np.random.default_rng(3)
    texts = []
    for name, text in licenses.TEMPLATES.items():
        w = text.split()
        if len(w) > 40:
            w[len(w) // 2] = "changed"
        texts.append((name, " ".join(["filler%d" % i for i in rng.integers(0, 999, 300)] + w + ["tail"] * 90)))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    found = {(r.doc_id, r.license) for r in licenses.scan_licenses(docs).collect()}
    assert {(i, name) for i, (name, _) in enumerate(texts)} <= found
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(empty).count() == 0


# --- 8


def test_archives_keep_payloads(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    archives = warc.write_archives(pages, str(tmp_path / "a"), chunk_bytes=5_000, archive_bytes=20_000)
    sizes = [r[0] for r in archives.groupBy("archive").agg(F.sum(F.length("data"))).collect()]
    assert len(sizes) > archives.rdd.getNumPartitions() and max(sizes) < 20_000 + 50_000
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(archives, payloads=True).filter("record_type = 'response'").collect()}
    want = {r.page_id: r.html for r in pages.collect()}
    assert got and all(want[k] == v for k, v in got.items())
    first = archives.agg(F.min("archive")).first()[0]
    (tmp_path / "files").mkdir()
    warc.export_archive(archives, first, str(tmp_path / "files/one.warc.gz"))
    assert warc.read_files(spark, str(tmp_path / "files")).count() == warc.read_archives(archives.filter(F.col("archive") == first)).count()
    members = [m for r in archives.orderBy("archive", "chunk").collect() for m in warc.inflate_members([bytes(r.data)])]
    ids = [re.search(rb"WARC-Record-ID: (\S+)", m)[1] for m in members]
    assert len(set(ids)) == len(ids) and sum(b"WARC-Type: warcinfo" in m for m in members) == len(sizes)


def test_broken_archives_are_refused():
    whole = warc._record(1, None, b"<p>", hashlib.sha1(b"<p>").digest(), None, 6)
    assert [warc.parse_record(m)["page_id"] for m in warc.inflate_members([whole[:5], whole[5:] + whole])] == [1, 1]
    with pytest.raises(warc.WarcError):
        list(warc.inflate_members([whole[:-3]]))
    assert warc.parse_record(next(warc.inflate_members([warc._member(["WARC/1.0", "WARC-Type: metadata"], b"x", 1)]))) == {"record_type": "metadata"}
    with pytest.raises(warc.WarcError):
        warc.parse_record(next(warc.inflate_members([warc._member(["WARC/1.0"], b"x", 1)])))
    wrong = warc._record(1, None, b"<p>", hashlib.sha1(b"<q>").digest(), None, 6)
    with pytest.raises(warc.WarcError):
        [warc.parse_record(m) for m in warc.inflate_members([wrong])]


def test_archives_of_odd_pages(spark):
    rows = [(1, "u", "x"), (3, None, "x"), (3, None, "x"), (2, "a\r\nb", None), (None, "u", "x"), (None, "u", "only null"), (None, "u", "only null"), (4, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("d")).withColumn("largest", F.lit(1))
    found = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    want = [(1, 1, "revisit", 3), (2, 0, "revisit", 4), (3, 1, "response", None), (3, 1, "response", None), (4, 0, "response", None), (None, 1, "revisit", 3), (None, 9, "response", None), (None, 9, "response", None)]
    assert found == sorted(want, key=str)
    assert {r.record_type for r in warc.round_trip(pages, min_bytes=100).collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


# --- 9


def check_scores(docs):
    rows = [(r.doc_id, [*(r.text or "").encode().lower().split(), b"\n"]) for r in docs.select("doc_id", "text").collect()]
    outside = lambda d: zlib.crc32(str("null" if d is None else d).encode()) % 10 == 0
    counts = Counter(w for d, own in rows if not outside(d) for w in own)
    n, v = sum(counts.values()), len(counts)
    base = lambda own: sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
    found = lm_score.score_documents(docs).collect()
    key = lambda d, h, t, k, m, b: (str(d), h, t, k, m, round(float(b), 5))
    assert sorted(key(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found) == sorted(key(d, outside(d), len(own), sum(w in counts for w in own), n, base(own)) for d, own in rows)
    return found


def test_model_beats_the_base(spark, docs):
    found = [r for r in check_scores(docs) if r.held_out]
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_probabilities_add_up_to_one():
    shares = np.full(20, 1 / 20)
    model = lm_score.LogBilinear(shares)
    contexts = np.repeat(np.arange(6)[None, :], 20, 0)
    assert np.exp(model.log_probabilities(contexts, np.arange(20))).sum() == pytest.approx(1, abs=1e-5)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    classes = np.tile([2, 3, 4, 5, 6, 7], 2_000)
    model = lm_score.LogBilinear(np.full(8, 1 / 8))
    contexts, memory = model.contexts(classes), {}
    before = model.log_probabilities(contexts, classes).mean()
    for at in 8 * list(range(0, len(classes), 500)):
        model.train(contexts[at : at + 500], classes[at : at + 500], memory, rng)
    assert model.log_probabilities(contexts, classes).mean() > before + 0.3


def test_probabilities_of_grouped_words_add_up_to_one():
    counts = np.arange(700, 0, -1.0)
    classes, grouped = lm_score._class_counts(counts)
    model = lm_score.LogBilinear(classes / classes.sum(), grouped)
    contexts = np.repeat(np.array([[3, 600, 5, 699, 0, 1]]), 700, 0)
    logs = model.log_probabilities(contexts, np.arange(700))
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5)
    stream = model.stream(np.array([1, 0, 699, 5, 600, 3, 650]))
    assert model.log_probabilities_along(np.concatenate([stream, stream]))[[6, 13]] == pytest.approx(logs[650], abs=1e-5)


def test_steps_along_a_text_are_those_by_contexts():
    counts, places = np.arange(700, 0, -1.0), np.random.default_rng(1).integers(0, 700, 60)
    classes, grouped = lm_score._class_counts(counts)
    one, two = (lm_score.LogBilinear(classes / classes.sum(), grouped) for _ in range(2))
    start = one.rows.copy()
    one.train(one.contexts(places), places, {}, np.random.default_rng(0))
    two.train_along(two.stream(places), {}, np.random.default_rng(0))
    assert np.allclose(one.rows, two.rows, atol=1e-4) and not np.allclose(one.rows, start, atol=1e-3)


def test_keys_of_words():
    texts = [b"", None, b"A b\ta", "\u00c9\u00e9 \u6f22".encode(), b" lead and  trail \n", b"x" * 300 + b" y", b"\x00 \x01", b"\n"]
    keys, counts = lm_score.keys_of(texts)
    own = [(t or b"").lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in own]
    assert keys.tolist() == [lm_score._signed(WordKeys.of(w)) for words_ in own for w in words_]
    assert [len(x) for x in lm_score.keys_of([])] == [0, 0]
    cut = WordKeys()
    cut.AT_ONCE = 8  # texts are cut, and words of more than 32 bytes hashed one by one
    texts += [b"word " * 50 + b"y" * 40 + b" end", b"z" * 33]
    assert [x.tolist() for x in cut.of_texts([(t or b"").lower() for t in texts])] == [x.view(np.uint64).tolist() if i == 0 else x.tolist() for i, x in enumerate(lm_score.keys_of(texts))]


def test_scores_are_those_of_a_plain_loop(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm_score, "VECTORS", 300)
    vocabulary = [f"w{i}" for i in range(500)]
    counts = np.arange(500, 0, -1)
    head = (lm_score.keys_of([" ".join(vocabulary[:450]).encode()])[0], counts[:450], 90)
    n, v = int(counts.sum()) + 90, 501
    known = np.concatenate([[0, 90], head[1][:300]]).astype(float)
    known[0] = n - known.sum()
    classes, grouped = lm_score._class_counts(known)
    shares = (classes + 1) / (classes + 1).sum()
    rng = np.random.default_rng(6)
    model = lm_score.LogBilinear(shares, grouped)
    model.rows += rng.standard_normal(model.rows.shape).astype(np.float32) * 0.3
    texts = [" ".join(rng.choice([*vocabulary, "new"], size)) for size in (0, 1, 3, 40)]
    rest = known[0] + 0.1 * (v - len(known) + 2)
    batch = pa.record_batch([pa.array(range(4), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    found = next(lm_score._scored(head, shares, grouped, model.rows, n, v, rest)(iter([batch]))).to_pylist()
    rows, w = model.rows.astype(float), lm_score.WIDTH
    for text, got in zip(texts, found):
        places = [vocabulary.index(x) + 2 if x in vocabulary[:450] else 0 for x in text.split()] + [1]
        seen, total = [model.before] * lm_score.CONTEXT, 0.0
        for place in places:
            own = place if place < 302 else 0
            q = sum(rows[model.c0 + i, :w] * rows[seen[-1 - i], :w] for i in range(lm_score.CONTEXT))
            softmax = lambda of: np.exp(of[:, :w] @ q + of[:, w]) / np.exp(of[:, :w] @ q + of[:, w]).sum()  # noqa: B023, E731
            of_class = softmax(rows[model.q0 : model.u0])
            group = (own - model.own) // lm_score.GROUP
            total += np.log10(of_class[own if own < model.own else model.own + group])
            if own >= model.own:
                first = model.u0 + group * lm_score.GROUP
                total += np.log10(softmax(rows[first : min(first + lm_score.GROUP, model.c0)])[own - model.own - group * lm_score.GROUP])
            if place != own:
                total += np.log10((counts[place - 2] + 0.1) / rest)
            seen.append(own)
        assert got["score_head"] == pytest.approx(total, abs=2e-3)
        assert sum(got["times"]) == places.count(0) and got["n_tokens"] == len(places)


def test_every_position_is_a_target(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm_score.LogBilinear, "_against_noise", lambda self, q, targets, rng, f=lm_score.LogBilinear._against_noise: (seen.extend(targets.tolist()), f(self, q, targets, rng))[1])
    monkeypatch.setattr(lm_score, "TRAINED_AT_ONCE", 200)
    import pyarrow as pa

    texts = [" ".join(f"w{(i * j) % 40}" for j in range(5 * i)) for i in range(1, 60)]
    counts = Counter(w for t in texts for w in t.encode().split())
    top = counts.most_common()
    head = (np.array([lm_score._signed(WordKeys.of(w)) for w, _ in top]), np.array([n for _, n in top]), len(texts))
    known = np.concatenate([[0, len(texts)], head[1]]).astype(float)
    classes, grouped = lm_score._class_counts(known)
    shares = (classes + 1) / (classes + 1).sum()
    batch = pa.record_batch([pa.array(range(1, 60), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    for round_ in range(lm_score.ROUNDS):
        list(lm_score._trained(head, shares, grouped, lm_score.LogBilinear(shares, grouped).rows, round_)(iter([batch])))
    want = Counter(w for i, t in enumerate(texts, 1) if not lm_score.held_out(i) for w in [*t.encode().split(), b"\n"])
    place = dict(zip((w for w, _ in top), range(2, 99))) | {b"\n": 1}
    assert Counter(seen) == Counter({place[w]: n for w, n in want.items()})


def test_order_of_rare_words_counts(spark):
    rng = np.random.default_rng(4)
    pairs = [f"left{i} right{i}" for i in range(400)]
    texts = [" ".join(pairs[j] for j in rng.permutation(400)) for _ in range(60)]
    texts += ["left7 right7 left9 right9", "left7 right9 left9 right7"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(1)
    found = {r.doc_id: r.score for r in lm_score.score_documents(docs).collect()}
    assert abs(found[60] - found[61]) > 1e-3


def test_scores_on_odd_tables(spark, odd, empty, monkeypatch):
    check_scores(odd)
    monkeypatch.setattr(lm_score, "HEAD", 300)  # most words are joined then
    check_scores(odd)
    assert lm_score.score_documents(empty).count() == 0


# --- 10


PRIVATE = [
    "mail jo.doe99@mail4.example.com, call +1 (017) 555-7713 or (212) 555-0199 or 212-555-0199.", "card 4111111111111111 and 4111-1111-1111-1111, time 1700000000123, account 9807915762804490!", "born 1984-02-29, not 1984-02-30; ssn 123-45-6789, not 000-12-3456",
    "host 97.51.17.173 not 397.51.17.173", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "nothing here: version 2.0.1, 12 apples, 3-4", None, "", "4111111111111111",
]


def luhn(digits):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


@pytest.fixture(scope="module")
def private(spark):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(PRIVATE)], "doc_id long, text string, _kinds string")
    rows = rows.withColumns({c: F.lit(c) for c in ("_found", "_key", "_text", "_row")})
    made = pii.pseudonymise(rows, "k")
    assert made.columns == rows.columns and all(r._found == "_found" and r._row == "_row" and r._kinds == "x" for r in made.collect())
    return {r.doc_id: r for r in pii.find_private(rows, "k").collect()}, {r.doc_id: r.text for r in made.collect()}


def test_pseudonyms_keep_formats(private):
    found, texts = private
    assert set(found) == {0, 1, 2, 3, 4, 8}
    assert (found[0].n_email, found[0].n_phone, found[1].n_card, found[2].n_date, found[2].n_ssn, found[3].n_ip, found[4].n_secret) == (1, 3, 2, 1, 1, 1, 1)
    shape = lambda t: re.sub("[a-f]", "a", re.sub("[0-9]", "9", t))
    for i in (1, 2, 4):
        assert shape(texts[i]) == shape(PRIVATE[i])
    for i, r in found.items():
        assert r.text == texts[i] != PRIVATE[i]
    assert texts[0].startswith("mail ") and "@mail4.example.com, call +1 (" in texts[0] and "not 1984-02-30" in texts[2] and "not 000-12-3456" in texts[2] and "not 397.51.17.173" in texts[3]
    assert [texts[i] for i in (5, 6, 7)] == PRIVATE[5:8]
    a, b = re.search(r"card (\d{16}) and ([\d-]{19})", texts[1]).groups()
    assert texts[1].endswith("time 1700000000123, account 9807915762804490!")  # fail the Luhn check
    assert a == b.replace("-", "") == texts[8] and luhn(a) == luhn("4111111111111111") == 0  # equal values stay linked
    assert all(0 <= int(x) < 256 for x in re.search(r"host (\S+)", texts[3])[1].split("."))


def test_pseudonyms_are_one_to_one(spark):
    dates = spark.range(0, 73_049, 7).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    made = [r.text for r in pii.find_private(dates, "k").collect()]
    assert len(set(made)) == len(made) == dates.count() and all("1900-01-01" <= d <= "2099-12-31" for d in made)
    ssns = spark.range(0, 3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("123-"), F.lpad((F.col("id") % 99 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("id") + 1).cast("string"), 4, "0")).alias("text"))
    made = [r.text for r in pii.find_private(ssns, "k").filter("n_ssn = 1").collect()]
    assert len(set(made)) == 3_000 and not any(m[:3] in ("000", "666") or m[0] == "9" for m in made)
    other = {r.text for r in pii.find_private(ssns, "another").collect()}
    assert len(other & set(made)) < 300


def test_compact_telephone_numbers(spark):
    texts = ["+14155550123", "+1 415 555 0123", "+442079460123", "+35312345678", "+1234 5", "+123", "+9991", "+35 12 34"]
    kept = ["+1", "+1 ", "+44", "+353", "+1", "+1", "+99", "+35 "]
    docs = spark.createDataFrame([(i, f"call {t}!") for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_private(docs, "k").collect()}
    assert {i: r.n_phone for i, r in found.items()} == dict.fromkeys(range(len(texts)), 1)
    for i, (text, start) in enumerate(zip(texts, kept)):
        assert re.sub("[0-9]", "9", found[i].text) == re.sub("[0-9]", "9", f"call {text}!") and found[i].text.startswith(f"call {start}")
    assert found[0].text == found[1].text.replace("+1 ", "+1").replace(" ", "").replace("call", "call ")  # one number, written in two ways
    every = spark.range(0, 1_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("+"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("text"))
    made = [r.text for r in pii.find_private(every, "k").collect()]
    assert len(set(made)) == len(made) == 1_000 and all(re.fullmatch("[+][0-9]{3}", m) for m in made)


class Feistel:
    """The pseudonyms in plain Python, from the module's docstring."""

    def __init__(self, key):
        self.key = key

    def sha(self, *parts):
        return hashlib.sha256("|".join([self.key, *map(str, parts)]).encode()).hexdigest()

    def pair(self, kind, left, right, m_left, m_right):
        for i in range(8):
            if i % 2 == 0:
                left = (left + int(self.sha(kind, i, right)[:12], 16)) % m_left
            else:
                right = (right + int(self.sha(kind, i, left)[:12], 16)) % m_right
        return left, right

    def digits(self, kind, d):
        half = len(d) // 2
        left, right = self.pair(kind, int(d[:half]), int(d[half:]), 10**half, 10 ** (len(d) - half))
        return f"{left:0{half}d}{right:0{len(d) - half}d}"

    def characters(self, kind, t, letters):
        left, right = t[: len(t) // 2], t[len(t) // 2 :]

        def moved(half, i, other):
            stream = bytes.fromhex(self.sha(kind, i, len(t), other))
            out = ""
            for j, c in enumerate(half):
                first, size = next(((f, n) for f, n in (("0", 10), ("a", letters), ("A", letters)) if f <= c <= chr(ord(f) + (9 if f == "0" else 25))), (None, 0))
                out += chr(ord(first) + (ord(c) - ord(first) + stream[j % 32]) % size) if first else c
            return out

        for i in range(8):
            if i % 2 == 0:
                left = moved(left, i, right)
            else:
                right = moved(right, i, left)
        return left + right

    def of(self, m):
        """(kind, pseudonym) of a match; (None, m) if it fails its validation."""
        import datetime

        only = re.sub("[^0-9]", "", m)
        refilled = lambda text, digits: re.sub("[0-9]", lambda _, it=iter(digits): next(it), text)
        if "@" in m:
            name, domain = m.split("@")
            return "email", f"{self.characters('email', name, 26)}@{domain}"
        if re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", m):
            first = datetime.date(1900, 1, 1)
            try:
                x = (datetime.date.fromisoformat(m) - first).days
            except ValueError:
                return None, m
            while True:
                a, b = self.pair("date", x // 271, x % 271, 271, 271)
                x = a * 271 + b
                if x < 73_049:
                    return "date", str(first + datetime.timedelta(x))
        if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", m):
            area, group, serial = map(int, m.split("-"))
            if area in (0, 666) or area >= 900 or not group or not serial:
                return None, m
            areas = [a for a in range(1, 900) if a != 666]
            a, b = self.pair("ssn", areas.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9_999)
            return "ssn", f"{areas[a // 99]:03d}-{a % 99 + 1:02d}-{b + 1:04d}"
        if re.fullmatch(r"[0-9]{1,3}([.][0-9]{1,3}){3}", m):
            o = list(map(int, m.split(".")))
            if max(o) > 255:
                return None, m
            a, b = self.pair("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65_536, 65_536)
            return "ip", f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
        if re.match("[+(]|[0-9]{3}-", m):
            code = re.match(pii.COUNTRY, m)
            at = code.end() if code else 0
            return "phone", m[:at] + refilled(m[at:], self.digits("phone", re.sub("[^0-9]", "", m[at:])))
        if len(m) >= 32:
            return "secret", self.characters("secret", m, 6)
        if luhn(only):
            return None, m
        body = self.digits("card", only[:-1])
        return "card", refilled(m, body + str((10 - luhn(body + "0")) % 10))


def private_value(rng):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = d(rng.randrange(12, 19))
    valid = card + str((10 - luhn(card + "0")) % 10)
    return rng.choice([
        lambda: "".join(rng.choice("azAZ09._-+%bq") for _ in range(rng.randrange(1, 40))) + "@" + rng.choice(["a.org", "mail-1.example.co.uk"]),
        lambda: f"{rng.choice(['19', '20'])}{d(2)}-{rng.randrange(14):02d}-{rng.randrange(33):02d}", lambda: f"{d(3)}-{d(2)}-{d(4)}",
        lambda: "+" + d(rng.randrange(2, 14)), lambda: f"+{d(rng.randrange(1, 4))} ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}",
        lambda: f"+{d(2)}.{d(2)}.{d(2)}", lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), lambda: valid, lambda: card + d(1),
        lambda: "-".join(valid[i : i + 4] for i in range(0, 16, 4)), lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(30, 67))),
        lambda: "".join(rng.choice("0123456789ABCDEF") for _ in range(40)), lambda: d(rng.randrange(1, 25)), lambda: "word",
    ])()


def test_pseudonyms_are_those_of_a_plain_feistel(spark):
    rng, feistel, pattern = random.Random(11), Feistel("a key"), re.compile(pii.PATTERN)
    texts = [rng.choice(["", "x ", "\u00e9\n"]) + rng.choice([" ", ", ", "; \n"]).join(private_value(rng) for _ in range(rng.randrange(1, 6))) for _ in range(10_000)]
    want = {}
    for i, t in enumerate(texts):
        kinds = [feistel.of(m[0])[0] for m in pattern.finditer(t)]
        if any(kinds):
            want[i] = (*[kinds.count(k) for k in pii.KINDS], pattern.sub(lambda m: feistel.of(m[0])[1], t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r[0]: tuple(r[1:]) for r in pii.find_private(docs, "a key").collect()}
    assert found == want and all(sum(w[k] for w in want.values()) > 200 for k in range(len(pii.KINDS)))


def test_key_stands_in_no_plan(spark, docs):
    key = "very-secret-key"
    for made in (pii.find_private(docs, key), pii.pseudonymise(docs, key)):
        made.count()
        assert key not in made._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        pii.find_private(docs, "")


def test_private_on_odd_tables(odd, empty):
    assert pii.find_private(odd, "k").count() == 0 and pii.pseudonymise(odd, "k").count() == odd.count()
    assert pii.find_private(empty, "k").count() == 0


# --- pipeline


def test_columns_of_any_name_pass(spark, docs):
    more = docs.withColumns({c: F.lit(c) for c in ("_row", "_s", "_b", "_plan", "_copy", "_copies", "_position", "_kept", "_first", "place", "bucket", "words")})
    for found, plain in ((mixing.mix_documents(more), mixing.mix_documents(docs)), (simhash.keep_one(more), simhash.keep_one(docs))):
        assert found.columns == more.columns
        rows = found.collect()
        assert all(r[c] == c for r in rows for c in more.columns if c not in docs.columns)
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain.collect())


def good(text):
    """The quality rules in plain words."""
    text = text or ""
    w, lines = text.encode().split(), [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(8)}
    count = lambda of: sum(c in of for c in text)
    upper, lower = (sum(first <= c <= last for c in text) for first, last in ("AZ", "az"))
    return not (
        len(w) < 20 or 100 * len(repeated) > 30 * len(w) or 10 * count("#*$%&|<>") > 3 * len(w) or upper > lower or 5 * sum(a == b for a, b in zip(w, w[1:])) > len(w)
        or 2 * (len(lines) - len(set(lines))) > len(lines) or sum(len(x.decode()) for x in w) > 40 * len(w)
    )


def check_stages(spark, data, docs):
    """Each stage against brute force on what the stage before kept; the last stage's rows."""
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    rows = lambda df: Counter(tuple(r) for r in df.collect())
    kept = stages["quality rules"](spark, docs, data)
    assert rows(kept) == Counter({k: n for k, n in rows(docs).items() if good(k[docs.columns.index("text")])})
    kept = kept.cache()
    one = stages["SimHash near-dedup"](spark, kept, data)
    of = brute_components({fingerprint(r.text) for r in kept.collect()})
    groups, found = defaultdict(list), defaultdict(list)
    for r in kept.collect():
        groups[of[fingerprint(r.text)]].append(r)
    for r in one.collect():
        found[of[fingerprint(r.text)]].append(r)
    least = lambda own: min((r.doc_id is None, r.doc_id or 0) for r in own)
    assert set(found) == set(groups) and all(len(x) == 1 and x[0] in groups[c] and least(x) == least(groups[c]) for c, x in found.items())
    one = one.cache()
    clean = stages["benchmark decontamination"](spark, one, data)
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    items = [tokens(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    asked = {n: set().union(*(windows(w, n) for w in items if min(10, len(w)) == n)) for n in range(1, 11)}
    text = docs.columns.index("text")
    assert rows(clean) == Counter({k: n for k, n in rows(one).items() if not any(a & windows(tokens(k[text]), n) for n, a in asked.items())})
    clean = clean.cache()
    mixed = stages["mixing sources to target weights"](spark, clean, data).cache()
    assert all(df.columns == docs.columns for df in (kept, one, clean, mixed))
    source, before, after = docs.columns.index("source"), rows(clean), rows(mixed)
    size = lambda k: len(words(k[text]))
    sizes, taken = Counter(), Counter()
    for k, n in before.items():
        sizes[k[source]] += n * size(k)
    for k, n in after.items():
        assert k in before and n <= 3 * before[k]
        taken[k[source]] += n * size(k)
    for name, want in targets(sizes).items() if sizes else ():
        assert abs(taken[name] - want) <= max((size(k) * n for k, n in before.items() if k[source] == name), default=0) / 2 + 1
    check_tokens(mixed)
    return stages["token-ID / binary output"](spark, mixed, data)


def test_pipeline_stages(spark, data, docs):
    import corpus_pipeline as p

    last = check_stages(spark, data, docs)
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, p.run(spark, data).collect())) == sorted(map(tuple, last.collect()))


def test_pipeline_on_odd_tables(spark, data, odd, empty):
    check_stages(spark, data, odd)
    assert check_stages(spark, data, empty).count() == 0

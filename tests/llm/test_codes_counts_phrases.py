"""Phrases, vector codes and token counts against brute force; and on odd tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from vismatch.llm import phrases, queries, token_counts, vector_codes

VOCABULARY = queries.word_vocabulary()


# --- 11


def mined(rows, least, longest, top):
    """Every column of the result by loops over all phrases."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split("[ \t]", piece) if w]
            totals[lang or "und"] += len(words)
            counts.update((lang or "und", *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    inside = {}
    for p, a in candidates.items():
        for i in range(1, len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p) - 1:
                    own = (p[0], *p[i:j])
                    inside[own] = max(inside.get(own, 0), a)
    out = []
    for p, a in candidates.items():
        if 100 * inside.get(p, 0) >= 100 * a:
            continue
        n = totals[p[0]]
        cut = min((1000 * a * n // (counts[p[:c]] * counts[(p[0], *p[c:])]), c) for c in range(2, len(p)))
        out.append((p[0], " ".join(p[1:]), a, counts[p[: cut[1]]], counts[(p[0], *p[cut[1] :])], n, cut[0]))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(own, 1)]
    return set(ranked)


@pytest.mark.parametrize("least,longest,top", [(2, 5, 10**6), (5, 3, 40)])
def test_phrases_are_those_of_brute_force(spark, docs, monkeypatch, least, longest, top):
    rows = docs.select("lang", "text").limit(80).collect()
    monkeypatch.setattr(phrases, "SLICE_BYTES", 5_000)
    own = spark.createDataFrame(rows, docs.select("lang", "text").schema).repartition(3)
    found = phrases.mine_phrases(own, least, longest, top).collect()
    assert {tuple(r) for r in found} == mined([tuple(r) for r in rows], least, longest, top) and len(found) == len(set(found))


def test_phrases_on_odd_tables(spark, odd, empty):
    rows = [(r.lang, r.text) for r in odd.select("lang", "text").collect()]
    found = phrases.mine_phrases(odd, 3, 5, 100_000).collect()
    assert {tuple(r) for r in found} == mined(rows, 3, 5, 100_000)
    assert phrases.mine_phrases(empty).count() == 0
    texts = ["A b. a B, a b;a\tb  a b:x\ny z!y  z?y z\x0by z", "", None, " . ", "É é É é"]
    frame = spark.createDataFrame([(None, t) for t in texts] * 2 + [("und", "a b")], "lang string, text string")
    assert {tuple(r) for r in phrases.mine_phrases(frame, 2).collect()} == mined([(None, t) for t in texts] * 2 + [("und", "a b")], 2, 5, 2_000)


def test_a_full_filter_changes_no_count(spark, docs, monkeypatch):
    rows = docs.select("lang", "text").limit(30).collect()
    own = spark.createDataFrame(rows, docs.select("lang", "text").schema)
    want = {tuple(r) for r in phrases.mine_phrases(own, 2).collect()}
    monkeypatch.setattr(phrases, "LARGEST_LOG", 15)  # most bits are set
    monkeypatch.setattr(phrases.Frequent, "has", lambda self, hashes: np.ones(len(hashes), bool))
    assert {tuple(r) for r in phrases.mine_phrases(own, 2).collect()} == want


def test_products_pass_64_bits(spark):
    rows = [("en", "q r", 10**9, 5)]
    assert rows
    value = spark.sql("select 1000 * cast(a as decimal(15)) * cast(n as decimal(17)) div (cast(l as decimal(18)) * cast(r as decimal(18))) as score from values (300000000000L, 90000000000000000L, 400000000000L, 500000000000L) as t(a, n, l, r)").first()[0]
    assert value == 1000 * 300000000000 * 90000000000000000 // (400000000000 * 500000000000)


# --- 12


def coded(rows, parts=8, entries=16, rounds=6):
    """Codes, errors and the digest by comparing all entries with Python's integers."""
    kept = [(i, [int(np.floor(4096 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    cut = lambda v: [tuple(v[len(v) * p // parts : len(v) * (p + 1) // parts]) for p in range(parts)]
    pieces = [cut(v) for _, v, _ in kept]
    books = [[own[p] for own in pieces[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = [[[] for _ in book] for book in books]
        for own in pieces:
            for p, x in enumerate(own):
                groups[p][near(p, x)[1]].append(x)
        books = [[tuple(sum(c) // len(g) for c in zip(*g)) if g else e for e, g in zip(book, group)] for book, group in zip(books, groups)]
    found = [[near(p, x) for p, x in enumerate(own)] for own in pieces]
    errors = [sum(d for d, _ in f) for f in found]
    labels = Counter()
    for (_, _, label), e in zip(kept, errors):
        labels[label] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{e:02x}" for _, e in f), e, labels[label], digest) for (i, _, label), f, e in zip(kept, found, errors))


def test_trees_find_the_nearest_entry_with_ties():
    rng = np.random.default_rng(3)
    for size in (1, 2, 4, 5, 16, 40):
        for spread, width in ((2, 1), (3, 4), (1000, 8), (1 << 26, 8)):
            entries = rng.integers(-spread, spread, (size, width))
            entries[size // 2 :] = entries[: size - size // 2]  # half of them twice
            x = np.concatenate([rng.integers(-spread, spread, (300, width)), entries])
            want = ((x[:, None, :] - entries[None]) ** 2).sum(2)
            entry, d = vector_codes.Tree(entries).nearest(x)
            assert (d == want.min(1)).all() and (entry == want.argmin(1)).all()


def test_a_tree_leaves_entries_out(monkeypatch):
    rng = np.random.default_rng(4)
    entries = np.concatenate([rng.integers(0, 50, (8, 8)), rng.integers(100_000, 100_050, (8, 8))])
    tree, met = vector_codes.Tree(entries), []
    squares = vector_codes._squares
    monkeypatch.setattr(vector_codes, "_squares", lambda x, y: met.append(len(x) * len(y)) or squares(x, y))
    tree.nearest(entries)
    assert sum(met) < 0.8 * len(entries) ** 2


def test_vector_codes_on_odd_tables(spark):
    rng = random.Random(5)
    vector = lambda: [rng.choice([0.0, 0.25, -1.5, rng.uniform(-2, 2)]) for _ in range(16)]
    rows = [(i, vector(), i % 3 if i % 5 else None) for i in range(60)]
    rows += rows[:7] + [(None, vector(), 1), (3, vector(), 2), (70, None, 1), (71, [None] + vector()[1:], 1), (72, [float("nan")] + vector()[1:], 1), (73, [float("-inf")] + vector()[1:], 1), (74, [0.5] * 8, 1), (75, [], 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(4)
    as_float = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    found = vector_codes.encode_vectors(frame).collect()
    assert Counter(tuple(r) for r in found) == coded(as_float)
    assert vector_codes.encode_vectors(frame.limit(0)).count() == 0
    few = spark.createDataFrame([(2, [0.1] * 8, None), (1, [-0.1] * 8, None)], "vec_id int, embedding array<double>, label string")
    assert Counter(tuple(r) for r in vector_codes.encode_vectors(few).collect()) == coded([(2, [0.1] * 8, None), (1, [-0.1] * 8, None)])
    with pytest.raises(Exception, match="no exact code"):
        vector_codes.encode_vectors(spark.createDataFrame([(1, [1e9] * 8, 1)], "vec_id int, embedding array<double>, label int")).count()
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.encode_vectors(spark.createDataFrame([(1, [1.0] * 9, 1)], "vec_id int, embedding array<double>, label int"))


# --- 13


def library(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(VOCABULARY)
    own.no_padding()
    own.no_truncation()
    return [len(e.ids) for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD_TEXTS = [
    "it's I'LL we've don't 'sample ''s 's's rock'n'roll", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> <|endof text|>", "J̌ é, É İ ≠ ≮ á́", "x y z\x0bq\x0cr\x85s \x1c\x1d t\x00u",
    "abc123DEF!!?...x_y-z 3² ٤٥", "漢字かな ABC漢", "ßSS ẞ ﬁ K İ", "a\r\nb\tc\n\n d", "\U0001f600\U0001f600 x\U0001f468‍\U0001f469", "", " ", None, "A" * 70, "ab" * 5_000, "1" * 300, "é,…, ….", "́a ́",
]


def test_token_counts_are_the_librarys(spark, docs, monkeypatch):
    rng = random.Random(6)
    pieces = [*"aZé'. ,<|>\n\t1٣漢́̌=", "'s", "'LL", "<|endoftext|>", "the ", "Word "]
    texts = ODD_TEXTS + ["".join(rng.choices(pieces, k=rng.randint(1, 60))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for head, size in ((1 << 17, 1 << 22), (3, 200)):
        monkeypatch.setattr(token_counts, "HEAD", head)
        monkeypatch.setattr(token_counts, "SLICE_BYTES", size)
        found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(frame, VOCABULARY).collect()}
        assert found == {i: (len((t or "").encode()), n, n > 2_048) for (i, t), n in zip(enumerate(texts), library(texts))}
    rows = docs.select("doc_id", "text").collect()
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, VOCABULARY).collect()}
    assert found == dict(zip([r.doc_id for r in rows], library([r.text for r in rows])))


def test_token_counts_on_odd_tables(spark, odd, empty):
    rows = odd.select("doc_id", "text").collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), n, n > 2_048) for r, n in zip(rows, library([r.text for r in rows])))
    assert Counter(tuple(r) for r in token_counts.count_tokens(odd, VOCABULARY).collect()) == want
    assert token_counts.count_tokens(empty, VOCABULARY).count() == 0
    with pytest.raises(ValueError, match="other rules"):
        token_counts.special_bytes(queries.tokenizer_file())

"""Language-model scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Tokens: A-Z lower-cased words, then one end for each text. Counts of all training tokens are made by Spark. The
``VECTORS`` most frequent words have vectors of their own, as context and as what is predicted, in two factors: the
``NEURAL`` - 2 most frequent ones, the end and all words without a vector are a class each, the others share classes by
groups of ``GROUP`` with counts alike:

    P(w | context) = P(class of w | context) P(w | its group, context), both softmaxes of
    score(x | context) = b[x] + Q[x] . sum_i C[i] * R[context_i]

over the ``CONTEXT`` tokens before. It is trained by noise-contrastive estimation against the unigram distributions of the
classes and of each group, in ``ROUNDS`` rounds: each task trains on its texts from the common parameters, which are then
averaged. Every training text is in one round, and each of its positions is a target. Scoring normalises: batched matrix
products give the scores of all classes, and those of the group's words. A word without a vector has, on top of its
class, its smoothed share among all such training words. Parameters depend on how the rows are dealt to tasks, as each
task trains on its own.

Where the counts of words are needed: the ``HEAD`` most frequent words go to the tasks, a table of bounded size; all
others are joined to the counts by a 64-bit hash of the word. Parameters and the head are of fixed size; what is
counted, trained on and joined grows with the input.

Defined cases: null and empty texts have the end alone; a null id takes part in training and in the report
(it counts as the text 'null'); repeated rows count each and each get a row; without training texts all counts are 0 and
the model is uniform over its classes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordKeys, as_bytes, blocks, materialise, shared_dir

NEURAL = 64
#: Words whose counts all tasks know, and words with vectors.
HEAD, VECTORS = 100_000, 32_768
CONTEXT = 6
WIDTH = 31  # with the bias 32 values
NOISE = 16
#: Words to a group, and noise words from a target's group.
GROUP, NOISE_INSIDE = 192, 2
ROUNDS = 2
BATCH = 1024
RATE = 0.05
#: Start of the sums of squared gradients, so that the first steps are small.
FIRST = 1e-6
SCORED_AT_ONCE = 1024
#: Places of texts that wait for training.
TRAINED_AT_ONCE = 1 << 16
#: Places whose vectors are held at once, and made at once.
RUN, AT_ONCE = 1 << 18, 1 << 12
#: Tokens of a training task at least: it moves most rows of the parameters, which should weigh less than its texts.
TASK_TOKENS = 6_000_000
SMOOTHING = 0.1
END = b"\n"  # no word holds a line end
_OTHER, _END = 0, 1
_COUNTED = 4_000_000
_keys = WordKeys()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


END_KEY = _signed(WordKeys.of(END))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode()) % 10 == 0


def _part(doc_id: int | None) -> int:
    return zlib.crc32(str(doc_id).encode()) // 10 % ROUNDS


def keys_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words of all texts, A-Z lower-cased, and the number of words of each."""
    keys, counts = _keys.of_texts([(t or b"").lower() for t in texts])
    return keys.view(np.int64), counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    ends = size = 0

    def flush() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([np.append(keys, END_KEY), np.append(n, ends)], names=["key", "n"])

    for batch in blocks(batches):
        texts = [t for d, t in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))) if not held_out(d)]
        if not texts:
            continue
        held.append(keys_of(texts)[0])
        ends, size = ends + len(texts), size + len(held[-1])
        if size > _COUNTED:
            yield flush()
            held, ends, size = [], 0, 0
    if ends:
        yield flush()


class Head:
    """The most frequent words: place by key, counts by place. Places 0 and 1 are all other words and the end."""

    SLOTS = 1 << 19  # of a table of open addresses

    def __init__(self, keys: np.ndarray, counts: np.ndarray, end: int) -> None:
        self.counts = np.concatenate([[0, end], counts]).astype(np.float64)
        self.key, self.place = np.zeros(self.SLOTS, np.int64), np.zeros(self.SLOTS, np.int64)
        for i, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist()), 2):
            while self.place[slot]:
                slot = (slot + 1) % self.SLOTS
            self.key[slot], self.place[slot] = key, i

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) >> np.uint64(20)).astype(np.int64) % self.SLOTS

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Place of each word; 0 if it is not in the head."""
        slot = self._slots(keys)
        found = self.place[slot]
        open_ = np.flatnonzero((found > 0) & (self.key[slot] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % self.SLOTS
            at = slot[open_]
            found[open_] = self.place[at]
            open_ = open_[(self.place[at] > 0) & (self.key[at] != keys[open_])]
        return found


class LogBilinear:
    """Parameters, noise-contrastive training and normalised scoring.

    All parameters are rows of one matrix, WIDTH values and a bias: R (places, then the row before a text), Q (classes),
    U (words in their groups) and C (the context's places; R and C have no bias)."""

    def __init__(self, shares: np.ndarray, grouped: np.ndarray = np.zeros(0), seed: int = 3) -> None:
        """shares: probability of each class, the noise; the last classes are the groups. grouped: counts of the words in them."""
        rng = np.random.default_rng(seed)
        n, words = len(shares), len(grouped)
        self.shares, self.own = shares, n - -(-words // GROUP)
        self.log_noise = np.log(shares * NOISE).astype(np.float32)
        self.before = self.own + words  # stands before a text
        self.q0 = self.before + 1
        self.u0 = self.q0 + n
        self.c0 = self.u0 + words
        self.rows = np.zeros((self.c0 + CONTEXT, WIDTH + 1), np.float32)
        self.rows[: self.u0, :WIDTH] = rng.standard_normal((self.u0, WIDTH)) * 0.1
        self.rows[self.q0 : self.u0, WIDTH] = np.log(shares)
        self.rows[self.c0 :, :WIDTH] = 1
        weights = grouped + 1.0
        self.ends = np.cumsum(weights)
        starts = np.arange(0, words, GROUP)
        self.group_end = self.ends[np.minimum(starts + GROUP, words) - 1]
        self.group_start = self.ends[starts] - weights[starts]
        inside = weights / (self.group_end - self.group_start)[np.arange(words) // GROUP]
        self.rows[self.u0 : self.c0, WIDTH] = np.log(inside)
        self.log_noise_inside = np.log(inside * NOISE_INSIDE).astype(np.float32)

    def load(self, rows: np.ndarray) -> LogBilinear:
        self.rows = rows.copy()
        return self

    def classes(self, places: np.ndarray) -> np.ndarray:
        return np.where(places < self.own, places, self.own + (places - self.own) // GROUP)

    def contexts(self, places: np.ndarray) -> np.ndarray:
        """For each position the CONTEXT places before it, nearest first."""
        return np.lib.stride_tricks.sliding_window_view(self.stream(places), CONTEXT)[: len(places), ::-1]

    def stream(self, places: np.ndarray) -> np.ndarray:
        """A text after what stands before it; streams of texts can be joined."""
        return np.concatenate([np.full(CONTEXT, self.before), places])

    def streams(self, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The joined streams of many texts, each with its end."""
        out = np.full(len(places) + len(sizes) * (CONTEXT + 1), self.before)
        out[np.arange(len(places)) + np.repeat(np.arange(len(sizes)) * (CONTEXT + 1) + CONTEXT, sizes)] = places
        out[np.cumsum(sizes + CONTEXT + 1) - 1] = _END
        return out

    def _along(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a stream, and the predicted vector, with 1 for the bias, of each position but the first CONTEXT."""
        r, c = np.take(self.rows, stream, axis=0), self.rows[self.c0 :]
        q = r[CONTEXT - 1 : -1] * c[0]
        for i in range(1, CONTEXT):
            q += r[CONTEXT - 1 - i : -1 - i] * c[i]
        q[:, WIDTH] = 1
        return r, q

    def _of_contexts(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self.rows[contexts]
        q = np.einsum("tij,ij->tj", r, self.rows[self.c0 :])
        q[:, WIDTH] = 1
        return r, q

    def log_probabilities(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target place, normalised over all."""
        return self._normalised(self._of_contexts(contexts)[1], targets)

    def log_probabilities_along(self, stream: np.ndarray) -> np.ndarray:
        """The same for all places of a stream of texts, without what stands before them."""
        out = []
        for at in range(CONTEXT, len(stream), RUN):
            run = stream[at - CONTEXT : at + RUN]
            own = run[CONTEXT:] != self.before
            q = np.empty((len(own), WIDTH + 1), np.float32)
            for a in range(0, len(own), AT_ONCE):  # small enough to stay in the processor's memory
                q[a : a + AT_ONCE] = self._along(run[a : a + AT_ONCE + CONTEXT])[1]
            out.append(self._normalised(q[own], run[CONTEXT:][own]))
        return np.concatenate(out)

    def _normalised(self, q: np.ndarray, targets: np.ndarray) -> np.ndarray:
        out = np.empty(len(targets))
        classes, of_classes = self.classes(targets), np.ascontiguousarray(self.rows[self.q0 : self.u0].T)
        rows = self.rows[self.q0 : self.c0]
        longest = [float(np.sqrt(np.einsum("tj,tj->t", x[:, :WIDTH], x[:, :WIDTH]).max(initial=0))) for x in (q, rows)]
        shift = longest[0] * longest[1] + float(np.abs(rows[:, WIDTH]).max()) > 60  # beyond that a power could overflow
        for at in range(0, len(targets), SCORED_AT_ONCE):
            part = slice(at, at + SCORED_AT_ONCE)
            out[part] = _chosen(q[part], of_classes, classes[part], shift)
        grouped = np.flatnonzero(targets >= self.own)
        grouped = grouped[np.argsort(classes[grouped], kind="stable")]
        edges = np.flatnonzero(np.diff(classes[grouped], prepend=-1, append=-1)).tolist() if len(grouped) else []
        for start, end in zip(edges, edges[1:]):
            first = (int(classes[grouped[start]]) - self.own) * GROUP
            words = self.rows[self.u0 + first : min(self.u0 + first + GROUP, self.c0)].T
            for at in range(start, end, SCORED_AT_ONCE):
                part = grouped[at : min(at + SCORED_AT_ONCE, end)]
                out[part] += _chosen(q[part], words, targets[part] - self.own - first, shift)
        return out

    def train(self, contexts: np.ndarray, targets: np.ndarray, memory: dict[str, np.ndarray], rng: np.random.Generator) -> None:
        """One step of noise-contrastive estimation with per-parameter step sizes."""
        r, q = self._of_contexts(contexts)
        dq, rows, grads = self._against_noise(q, targets, rng)
        dr = (dq[:, None, :] * self.rows[self.c0 :]).reshape(-1, WIDTH + 1)
        self._move([contexts.ravel(), *rows], [dr, *grads], np.einsum("tj,tij->ij", dq, r), len(targets), memory)

    def train_along(self, stream: np.ndarray, memory: dict[str, np.ndarray], rng: np.random.Generator) -> None:
        """The same step with all places of a stream but its first CONTEXT, and what stands before texts, as targets."""
        r, q = self._along(stream)
        own = np.flatnonzero(stream[CONTEXT:] != self.before)
        if not len(own):
            return
        dq = np.zeros_like(q)
        dq[own], rows, grads = self._against_noise(q[own], stream[CONTEXT:][own], rng)
        c, dr, dc = self.rows[self.c0 :], np.zeros_like(r), np.empty((CONTEXT, WIDTH + 1), np.float32)
        for i in range(CONTEXT):
            dr[CONTEXT - 1 - i : -1 - i] += dq * c[i]
            dc[i] = np.einsum("tj,tj->j", dq, r[CONTEXT - 1 - i : -1 - i])
        self._move([stream, *rows], [dr, *grads], dc, len(own), memory)

    def _against_noise(self, q: np.ndarray, targets: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, list, list]:
        """Gradients by the predicted vectors, and by rows: of the class against shared noise, of the word in its group."""
        classes, noise = self.classes(targets), rng.choice(len(self.shares), NOISE, p=self.shares)
        of_targets, of_noise = np.take(self.rows, self.q0 + classes, axis=0), self.rows[self.q0 + noise]
        g = _sigmoid(np.einsum("tj,tj->t", q, of_targets) - self.log_noise[classes]) - 1
        h = _sigmoid(q @ of_noise.T - self.log_noise[noise])
        dq = g[:, None] * of_targets + h @ of_noise
        rows, grads = [self.q0 + classes, self.q0 + noise], [g[:, None] * q, h.T @ q]
        inside = np.flatnonzero(targets >= self.own)
        if len(inside):
            group, words, own = classes[inside] - self.own, targets[inside] - self.own, q[inside]
            start, end = self.group_start[group, None], self.group_end[group, None]
            drawn = np.searchsorted(self.ends, start + (end - start) * rng.random((len(inside), NOISE_INSIDE)), side="right")
            words = np.concatenate([words[:, None], np.minimum(drawn, np.minimum((group + 1) * GROUP, len(self.ends))[:, None] - 1)], 1)
            of_words = np.take(self.rows, self.u0 + words, axis=0)
            d = _sigmoid(np.einsum("nkj,nj->nk", of_words, own) - self.log_noise_inside[words])
            d[:, 0] -= 1
            dq[inside] += np.einsum("nk,nkj->nj", d, of_words)
            rows.append(self.u0 + words.ravel())
            grads.append((d[:, :, None] * own[:, None, :]).reshape(-1, WIDTH + 1))
        dq[:, WIDTH] = 0
        return dq, rows, grads

    def _move(self, rows: list, grads: list, dc: np.ndarray, size: int, memory: dict[str, np.ndarray]) -> None:
        if not memory:
            memory["squares"], memory["times"] = np.full(len(self.rows), FIRST, np.float32), np.zeros(len(self.rows), np.int64)
        at = np.concatenate([*rows, np.arange(self.c0, self.c0 + CONTEXT)])
        order = np.argsort(at)
        at = at[order]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        # pairs of values are added as complex numbers, which takes numpy a third of the time
        pairs = np.take(np.concatenate([*grads, dc]), order, axis=0).view(np.complex64)
        grad = np.add.reduceat(pairs, starts, axis=0).view(np.float32) / np.float32(size)
        times, at = np.diff(starts, append=len(at)), at[starts]
        memory["times"][at] += times
        squares = memory["squares"][at] + np.einsum("nj,nj->n", grad, grad) / np.float32(WIDTH + 1)
        memory["squares"][at] = squares
        grad *= (RATE / np.sqrt(squares))[:, None]
        grad[:, WIDTH] *= np.float32(0.2)
        grad[-CONTEXT:] *= np.float32(0.2)  # the rows of C are the last
        self.rows[at] = np.take(self.rows, at, axis=0) - grad


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -30, 30)))


def _chosen(q: np.ndarray, columns: np.ndarray, chosen: np.ndarray, shift: bool) -> np.ndarray:
    """Log of the softmax over columns, at one column for each row of q."""
    scores = q @ columns
    if shift:
        scores -= scores.max(1, keepdims=True)
    out = scores[np.arange(len(q)), chosen].astype(np.float64)
    np.exp(scores, out=scores)
    return out - np.log(scores.sum(1))


def _with_vectors(places: np.ndarray) -> np.ndarray:
    """Places for the model: words without a vector are one."""
    return np.where(places < VECTORS + 2, places, _OTHER)


def _class_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the classes, from those of the places, and of the words in groups."""
    grouped = counts[NEURAL:]
    return np.concatenate([counts[:NEURAL], np.add.reduceat(grouped, np.arange(0, len(grouped), GROUP)) if len(grouped) else grouped]), grouped


def _trained(head: tuple, shares: np.ndarray, grouped: np.ndarray, rows: np.ndarray, round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model, memory = Head(*head), LogBilinear(shares, grouped).load(rows), {}
        held: list[np.ndarray] = []
        waiting = tokens = 0
        rng = np.random.default_rng(round_)

        def step() -> None:
            nonlocal held, waiting
            stream = np.concatenate(held)
            for at in range(CONTEXT, len(stream), BATCH):
                model.train_along(stream[at - CONTEXT : at + BATCH], memory, rng)
            held, waiting = [], 0

        for batch in blocks(batches):
            texts = [t for d, t in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))) if not held_out(d) and _part(d) == round_]
            if not texts:
                continue
            keys, sizes = keys_of(texts)
            held.append(model.streams(_with_vectors(words.of(keys)), sizes))
            tokens += len(keys) + len(texts)
            waiting += len(held[-1])
            if waiting >= TRAINED_AT_ONCE:
                step()
        if waiting:
            step()
        if tokens:
            times = memory["times"]
            times[model.q0 : model.u0] = times[model.c0 :] = tokens
            moved = np.flatnonzero(times)
            for at in range(0, len(moved), _ROWS):
                own = moved[at : at + _ROWS]
                yield pa.record_batch([pa.array(own), pa.array(times[own]), _lists(model.rows[own])], names=["i", "n", "v"])

    return run


_ROWS = 8_192  # rows of parameters to an Arrow batch


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, WIDTH + 1), pa.int32()), pa.array(rows.ravel()))


def _values(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH + 1)


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean of each row of parameters, whose values are all in this partition."""
    place: dict[int, int] = {}
    sums, total = np.zeros((0, WIDTH + 1)), np.zeros(0)
    for batch in batches:
        at = np.array([place.setdefault(i, len(place)) for i in batch.column("i").to_pylist()], np.int64)
        if len(place) > len(total):
            more = 2 * len(place) - len(total)
            sums, total = np.pad(sums, ((0, more), (0, 0))), np.pad(total, (0, more))
        n = batch.column("n").to_numpy().astype(np.float64)
        np.add.at(sums, at, _values(batch.column("v")) * n[:, None])
        np.add.at(total, at, n)
    if place:
        n = len(place)
        yield pa.record_batch([pa.array(list(place), pa.int64()), _lists((sums[:n] / total[:n, None]).astype(np.float32))], names=["i", "v"])


def _averaged(trained: DataFrame, rows: np.ndarray) -> np.ndarray:
    """Each row averaged over the tasks that moved it, by how often they did, and Q and C by tokens; a bounded number of
    rows reaches the driver."""
    found = trained.repartition("i").mapInArrow(_means, "i long, v array<float>").toArrow()
    out = rows.copy()
    for batch in found.to_batches():
        if batch.num_rows:
            out[batch.column("i").to_numpy()] = _values(batch.column("v"))
    return out


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_head long, base_head double, score_head double, others array<long>, times array<int>"


def _scored(head: tuple, shares: np.ndarray, grouped: np.ndarray, rows: np.ndarray, train_tokens: int, distinct: int, rest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = Head(*head), LogBilinear(shares, grouped).load(rows)
        base = np.log10((words.counts + SMOOTHING) / (train_tokens + SMOOTHING * (distinct + 1)))
        share = np.where(np.arange(len(base)) < VECTORS + 2, 0, np.log10((words.counts + SMOOTHING) / rest))
        for batch in blocks(batches):
            ids = batch.column("doc_id").to_pylist()
            keys, n_words = keys_of(as_bytes(batch.column("text")))
            flat = words.of(keys)
            text = np.repeat(np.arange(len(ids)), n_words)
            sizes = n_words + 1
            ends = np.cumsum(sizes) - 1
            flat_places = np.full(len(flat) + len(ids), _END)
            flat_places[np.arange(len(flat)) + text] = flat
            streams = model.streams(_with_vectors(flat), n_words)
            model_part = model.log_probabilities_along(streams) / np.log(10) + share[flat_places]
            base_part = np.where(flat_places > 0, base[flat_places], 0)
            known = (words.counts[flat_places] > 0) & (flat_places > 0)
            starts = ends - n_words
            rare = np.flatnonzero(flat == 0)
            rare = rare[np.lexsort((keys[rare], text[rare]))]
            fresh = np.flatnonzero((np.diff(text[rare], prepend=-1) != 0) | np.append(True, np.diff(keys[rare]) != 0)[: len(rare)])
            others_at = pa.array(np.searchsorted(text[rare][fresh], np.arange(len(ids) + 1)), pa.int32())
            others = pa.ListArray.from_arrays(others_at, pa.array(keys[rare][fresh]))
            times = pa.ListArray.from_arrays(others_at, pa.array(np.diff(np.append(fresh, len(rare))), pa.int32()))
            yield pa.record_batch(
                [
                    batch.column("doc_id"), pa.array([held_out(d) for d in ids]), pa.array(sizes), pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                    pa.array(np.add.reduceat(base_part, starts)), pa.array(np.add.reduceat(model_part, starts)), others, times,
                ],
                names=["doc_id", "held_out", "n_tokens", "n_head", "base_head", "score_head", "others", "times"],
            )

    return run


def most_frequent(counts: DataFrame, most: int = HEAD) -> pd.DataFrame:
    """The words of at least some count, the least that leaves ``most`` of them or fewer; most frequent first.

    The count is one of eight steps to a factor of two, found from a few hundred sums; no task sends more than its share."""
    step = F.floor(8 * F.log2(F.col("n")))
    steps = sorted(((r["step"], r["words"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
    total, least = 0, None
    for at, words in steps:
        total += words
        if total > most:
            break
        least = at
    found = counts.filter(step >= F.lit(least)) if least is not None else counts.limit(0)
    return found.toPandas().sort_values(["n", "key"], ascending=[False, True])


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = materialise(columns.mapInArrow(_counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), f"{folder}/counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("key") == END_KEY, F.col("n"))), F.lit(0)).alias("end")).first()
    top = most_frequent(counts.filter(F.col("key") != END_KEY))
    head = (top["key"].to_numpy(np.int64), top["n"].to_numpy(np.int64), totals["end"])
    known = np.concatenate([[0, totals["end"]], head[1][:VECTORS]]).astype(np.float64)
    known[_OTHER] = max(0, totals["n"] - known.sum())
    classes, grouped = _class_counts(known)
    shares = (classes + 1) / (classes + 1).sum()
    rows = LogBilinear(shares, grouped).rows
    dealt = columns.coalesce(1 + int(totals["n"]) // TASK_TOKENS)
    for round_ in range(ROUNDS):
        rows = _averaged(dealt.mapInArrow(_trained(head, shares, grouped, rows, round_), "i long, n long, v array<float>"), rows)
    rest = known[_OTHER] + SMOOTHING * (max(0, totals["v"] - len(known) + 1) + 1)
    scored = columns.mapInArrow(_scored(head, shares, grouped, rows, totals["n"], totals["v"], rest), _SCORED)
    scores = materialise(scored.withColumn("row", F.monotonically_increasing_id()), f"{folder}/scored")
    smoothed = F.coalesce("n", F.lit(0)) + F.lit(SMOOTHING)
    rare = scores.select("row", F.explode(F.arrays_zip("others", "times")).alias("o")).select("row", F.col("o.others").alias("key"), F.col("o.times").alias("times"))
    found = rare.join(counts, "key", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_rare"),
        F.sum(F.col("times") * F.log10(smoothed / F.lit(totals["n"] + SMOOTHING * (totals["v"] + 1)))).alias("base_rare"),
        F.sum(F.col("times") * F.log10(smoothed / F.lit(rest))).alias("score_rare"),
    )
    joined = scores.drop("others", "times").join(found, "row", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(totals["n"]).cast("long").alias("train_tokens"),
        (F.col("base_head") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"), (F.col("score_head") + F.coalesce("score_rare", F.lit(0.0))).alias("score"),
    )

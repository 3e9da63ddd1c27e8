"""Token ids in binary files, coded with a static range asymmetric numeral system (rANS).

Texts are dealt by ranges of doc_id and sorted, tokenised, and cut into units of whole documents. Each task counts its
ids; the sums of the counts, scaled to 2**20, are the frequency table that all blocks share. Then every unit is coded
and decoded on its own.

Format of a unit's payload (little-endian), one block after another:
    n_ids u32, n_words u32, crc32 of the ids as u32 values u32, n_checkpoints u32,
    for each checkpoint: words read before it u32, LANES states u64,
    the words u32.
A block holds up to BLOCK ids; id t belongs to lane t % LANES, step t // LANES. There is a checkpoint every
CHECKPOINT_STEPS steps, from which decoding can start; a decoder runs all checkpoints of all blocks side by side.
Units are rows of a Parquet table (part, unit, doc_ids, lengths, payload), which any store of Spark's can hold and whose
writing survives lost tasks.

Text is cut at single spaces before it is tokenised, where the byte-level pattern always begins a new piece; the units
are coded by the tokenizers library and remembered by hashes of 96 bits and their length. Texts with a blank after a space are coded whole, and so are texts
with the string of an added token, which gets that token's id as by the library's defaults.

Defined cases: null and empty texts have the end id alone; null ids come first; rows that repeat an id stay neighbours,
ordered by a hash of their texts; an empty table gives empty files.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import as_bytes, blocks, drop, materialise, mix, shared_dir

END_ID = 2
SCALE_BITS = 20
LANES = 64
BLOCK = 1 << 15
CHECKPOINT_STEPS = 256
UNIT_IDS = 1 << 20
_LOW = np.uint64(1 << 31)
_UNITS = "part int, unit int, n_ids long, doc_ids array<long>, lengths array<long>"


def _byte_characters() -> dict[str, str]:
    """The characters by which byte-level models write the 256 bytes: printable ones stand for themselves, the others
    follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): chr(b) for b in printable} | {chr(b): chr(256 + i) for i, b in enumerate(others)}


class _BlankAfterSpace(Exception):
    """A space with a blank or nothing after it, which the pattern may join to the blanks before it."""


class _Remembered:
    """Ids by unit, in flat arrays: a table of open addresses by a 64-bit hash, with 32 further bits and the length
    compared. It starts anew when it is half full, so its memory is bounded, at 59 MB and the ids of a million units."""

    SLOTS = 1 << 21

    def __init__(self, dtype: np.dtype) -> None:
        self.key = np.zeros(self.SLOTS, np.uint64)  # 0: free
        self.check = np.zeros(self.SLOTS, np.uint64)
        self.start, self.count = np.zeros(self.SLOTS, np.int64), np.zeros(self.SLOTS, np.int32)
        self.ids, self.used, self.units = np.zeros(1 << 16, dtype), 0, 0

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 if it is not there."""
        slot = (key >> np.uint64(20)).astype(np.int64) % self.SLOTS
        found, open_ = np.full(len(key), -1), np.arange(len(key))
        while len(open_):
            at = slot[open_]
            there = self.key[at]
            same = (there == key[open_]) & (self.check[at] == check[open_])
            found[open_[same]] = at[same]
            open_ = open_[~same & (there != 0)]
            slot[open_] = (slot[open_] + 1) % self.SLOTS
        return found

    def add(self, key: np.ndarray, check: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """Keep distinct new units; returns their slots."""
        flat = np.frombuffer(b"".join(ids), self.ids.dtype)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + len(flat), self.ids.dtype)])
        self.ids[self.used : self.used + len(flat)] = flat
        count = np.array([len(x) for x in ids]) // self.ids.itemsize
        start = self.used + np.cumsum(count) - count
        self.used, self.units = self.used + len(flat), self.units + len(key)
        slot, open_ = (key >> np.uint64(20)).astype(np.int64) % self.SLOTS, np.arange(len(key))
        while len(open_):  # of those that want a free slot, the last one gets it
            free = open_[self.key[slot[open_]] == 0]
            self.key[slot[free]] = key[free]
            self.check[slot[free]] = check[free]
            won = free[(self.key[slot[free]] == key[free]) & (self.check[slot[free]] == check[free])]
            self.start[slot[won]], self.count[slot[won]] = start[won], count[won]
            open_ = np.setdiff1d(open_, won)
            slot[open_] = (slot[open_] + 1) % self.SLOTS
        return slot

    def forget(self) -> None:
        self.key[:] = 0
        self.used = self.units = 0


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n, base & (1 << 64) - 1, np.uint64)), dtype=np.uint64)


class Tokens:
    """Texts to ids, as arrays of u16 or u32 values.

    Units between spaces are hashed and looked up together for many texts; new ones are coded one by one. A new unit
    that is letters, then ASCII punctuation, is those two pieces of the pattern, and a line end between such units is
    one; each is coded by the library's model. All other new units, and texts with a blank after a space or an added
    token, go through the library's whole tokenizer."""

    LONG = 64
    AT_ONCE = 1 << 18  # bytes of text hashed together; longer texts are cut at spaces
    PLAIN = 50_000  # pieces without a space before them that are remembered
    PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    BASES = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so that they have inverses modulo 2**64

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.characters = str.maketrans(_byte_characters())
        self.space = self.characters[ord(" ")]
        self.units, self.plain = _Remembered(self.dtype), {"": b""}
        self.powers = [(_powers(b, 0), _powers(pow(b, -1, 1 << 64), 0)) for b in self.BASES]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _written(self, written: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(written)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of the pattern."""
        return self._written(piece.encode().decode("latin-1").translate(self.characters))

    def _plain(self, piece: str) -> bytes:
        found = self.plain.get(piece)
        if found is None:
            if len(self.plain) > self.PLAIN:
                self.plain = {"": b""}
            found = self.plain[piece] = self._piece(piece)
        return found

    def _new(self, unit: str, spaced: bool) -> bytes:
        core = unit.rstrip(self.PUNCTUATION)
        if core.isalpha() and spaced:  # the usual case: a word, or a word with punctuation; printable ASCII stands for itself
            ids = self._written(self.space + core) if core.isascii() else self._piece(" " + core)
            return ids + self._plain(unit[len(core) :]) if len(core) < len(unit) else ids
        if spaced and (not unit or unit[0].isspace()):
            raise _BlankAfterSpace
        parts = unit.split("\n")
        cores = [p.rstrip(self.PUNCTUATION) for p in parts]
        if not all(map(str.isalpha, cores)):
            return self._whole(" " + unit if spaced else unit)
        out = [self._piece(" " + cores[0] if spaced else cores[0]), self._plain(parts[0][len(cores[0]) :])]
        for part, core in zip(parts[1:], cores[1:]):
            out += self._plain("\n"), self._plain(core), self._plain(part[len(core) :])
        return b"".join(out)

    def _hashed(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each unit; the first unit of a text differs from the same one after a space."""
        if len(codes) >= len(self.powers[0][0]):
            n = len(codes) + self.AT_ONCE
            self.powers = [(_powers(b, n), _powers(pow(b, -1, 1 << 64), n)) for b in self.BASES]
        values, kind = codes.astype(np.uint64) + np.uint64(1), ((end - start) * 2 + first).astype(np.uint64)
        out = []
        for power, inverse in self.powers:
            sums = np.append(np.uint64(0), np.cumsum(values * power[: len(values)]))
            out.append(mix((sums[end] - sums[start]) * inverse[start] + kind * np.uint64(self.BASES[1])))
        return out[0] | np.uint64(1), (out[1] >> np.uint64(32)) << np.uint64(16) | kind & np.uint64(0xFFFF)

    def _coded(self, texts: list[bytes], firsts: list[bool]) -> list[np.ndarray | None]:
        """Ids of texts or of parts of texts after a space; None for those that must be coded whole."""
        data = b" " + b" ".join(texts) + b" "
        codes = np.frombuffer(data, np.uint8)
        spaces = np.flatnonzero(codes == 32)
        start, end = spaces[:-1] + 1, spaces[1:]
        sizes = np.array([len(t) for t in texts])
        begins = np.cumsum(sizes + 1) - sizes  # of the texts
        lead = np.searchsorted(start, begins)
        first = np.zeros(len(start), bool)
        first[lead] = firsts
        key, check = self._hashed(codes, start, end, first)
        if self.units.units + len(key) > self.units.SLOTS // 2:
            self.units.forget()
        slot = self.units.find(key, check)
        new = np.flatnonzero(slot < 0)
        bad = np.zeros(len(start), bool)
        own: dict[int, bytes] = {}  # units too long to remember
        if len(new):
            _, at, of = np.unique(key[new], return_index=True, return_inverse=True)
            ids, keep, made = [], [], np.full(len(at), -1)
            places = zip(new[at].tolist(), start[new[at]].tolist(), end[new[at]].tolist(), first[new[at]].tolist())
            for i, (u, a, b, lone) in enumerate(places):
                unit = data[a:b]
                try:
                    found = self._new(unit.decode(), not lone)
                except _BlankAfterSpace:
                    bad[u] = True
                    continue
                if len(unit) > self.LONG:
                    own[i] = found
                else:
                    keep.append(i)
                    ids.append(found)
            keep = np.array(keep, np.int64)
            made[keep] = self.units.add(key[new[at[keep]]], check[new[at[keep]]], ids)
            slot[new] = made[of]
            bad[new] = bad[new[at]][of] | (check[new] != check[new[at]][of])  # the latter if 64 bits were not enough
        count, begin = self.units.count[slot].astype(np.int64), self.units.start[slot]
        flat = self.units.ids
        if own:
            longer = new[np.isin(of, list(own))]
            place = dict(zip(own, np.cumsum([0, *map(len, own.values())]).tolist()))
            which = of[np.searchsorted(new, longer)].tolist()
            count[longer] = [len(own[i]) // self.dtype.itemsize for i in which]
            begin[longer] = [len(flat) + place[i] // self.dtype.itemsize for i in which]
            flat = np.concatenate([flat, np.frombuffer(b"".join(own.values()), self.dtype)])
        count[bad] = 0
        total = np.cumsum(count)
        found = flat[np.arange(int(total[-1])) + np.repeat(begin - total + count, count)]
        cuts = np.append(0, total)
        bounds = np.append(lead, len(start))
        wrong = np.add.reduceat(bad, lead) > 0 if len(lead) else []
        return [None if w else found[cuts[a] : cuts[b]] for a, b, w in zip(bounds[:-1], bounds[1:], wrong)]

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of UTF-8 texts."""
        parts: list[list[np.ndarray | None]] = [[] for _ in texts]
        held: list[tuple[int, bytes, bool]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if held:
                for (i, _, _), ids in zip(held, self._coded([t for _, t, _ in held], [f for _, _, f in held])):
                    parts[i].append(ids)
            held, size = [], 0

        for i, text in enumerate(texts):
            at = 0
            if not text or any(map(text.__contains__, self.added)):
                continue
            while at >= 0:
                cut = text.find(b" ", at + self.AT_ONCE)
                if (len(text) if cut < 0 else cut) - at > 4 * self.AT_ONCE:  # a unit too long to hash: the text is coded whole
                    parts[i].append(None)
                    break
                held.append((i, text[at:] if cut < 0 else text[at:cut], at == 0))
                size += len(held[-1][1])
                at = cut + 1 if cut >= 0 else -1
                if size >= self.AT_ONCE:
                    flush()
        flush()
        out = []
        for text, own in zip(texts, parts):
            if text and (not own or any(p is None for p in own)):
                own = [np.frombuffer(self._whole(text.decode()), self.dtype)]
            out.append(own[0] if len(own) == 1 else np.concatenate(own) if own else np.zeros(0, self.dtype))
        return out


_tokens: dict[str, Tokens] = {}


def _of_worker(path: str) -> Tokens:
    """One tokenizer, with what it remembers, for all tasks of a worker process."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def _tokenised(tokenizer: str):
    """Units of whole documents; the last one of a task carries the counts of all the task's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, unit, tokens = TaskContext.get().partitionId(), 0, _of_worker(tokenizer)
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        total, end = 0, np.array([END_ID], tokens.dtype)
        counts = np.zeros(tokens.tokenizer.get_vocab_size(), np.int64)

        def flush(last: bool) -> pa.RecordBatch:
            ids, lengths = np.concatenate(held), [len(x) for x in held]
            counts[:] += np.bincount(ids, minlength=len(counts))
            columns = [pa.array([part], pa.int32()), pa.array([unit], pa.int32()), pa.array([sum(lengths)], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64()))]
            columns += [pa.array([ids.tobytes()], pa.binary()), pa.array([counts.tobytes() if last else None], pa.binary())]
            return pa.record_batch(columns, names=["part", "unit", "n_ids", "doc_ids", "lengths", "ids", "counts"])

        for batch in blocks(batches):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tokens.of(as_bytes(batch.column("text")))):
                if total >= UNIT_IDS:
                    yield flush(False)
                    docs, held, total, unit = [], [], 0, unit + 1
                docs.append(doc)
                held.append(np.append(ids, end))
                total += len(held[-1])
        if docs:
            yield flush(True)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of the tasks added up: a row for each id used."""
    total = None
    for batch in batches:
        for row in batch.column("counts").to_pylist():
            counts = np.frombuffer(row, np.int64)
            total = counts.copy() if total is None else total + counts
    if total is not None:
        used = np.flatnonzero(total)
        yield pa.record_batch([used, total[used]], names=["id", "n"])


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**SCALE_BITS, at least 1 for every id that occurs."""
    goal = 1 << SCALE_BITS
    if (counts > 0).sum() > goal:
        raise ValueError("more ids than the frequency table has places")
    if not counts.sum():
        return np.append(goal, np.zeros(max(len(counts) - 1, 0), np.int64))
    out = np.where(counts > 0, np.maximum(1, (counts * (goal / counts.sum())).astype(np.int64)), 0)
    order = np.argsort(-counts, kind="stable")
    over = int(out.sum()) - goal
    for i in order.tolist():  # rarely more than the first few
        if over <= 0:
            break
        less = min(over, int(out[i]) // 2)
        out[i] -= less
        over -= less
    out[order[0]] -= min(over, 0)
    return out


class Coder:
    """rANS with shared frequencies; numpy works on all lanes of many blocks at once."""

    def __init__(self, frequencies: np.ndarray) -> None:
        self.f = frequencies.astype(np.uint64)
        self.c = (np.cumsum(frequencies) - frequencies).astype(np.uint64)
        self.slot: np.ndarray | None = None
        self.counts = frequencies

    def encode(self, ids: np.ndarray) -> bytes:
        sizes = [min(BLOCK, len(ids) - at) for at in range(0, len(ids), BLOCK)]
        n = len(sizes)
        steps = -(-max(sizes, default=0) // LANES)
        grid, used = np.zeros((n, steps * LANES), np.int64), np.zeros((n, steps * LANES), bool)
        for b, size in enumerate(sizes):
            grid[b, :size], used[b, :size] = ids[b * BLOCK : b * BLOCK + size], True
        grid, used = grid.reshape(n, steps, LANES), used.reshape(n, steps, LANES)
        state = np.full((n, LANES), _LOW)
        words, sent = np.zeros((n, steps, LANES), np.uint32), np.zeros((n, steps, LANES), bool)
        marks = {}
        low32, by32, scale = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(SCALE_BITS)
        all_used = used.all((0, 2))
        for step in range(steps - 1, -1, -1):
            ids_now, now = grid[:, step], used[:, step]
            f, c = self.f[ids_now], self.c[ids_now]
            if not all_used[step]:
                f, c = np.where(now, f, np.uint64(1)), np.where(now, c, np.uint64(0))
            full = state >= f << np.uint64(63 - SCALE_BITS)
            if not all_used[step]:
                full &= now
            words[:, step], sent[:, step] = state & low32, full
            before = np.where(full, state >> by32, state)
            q = before // f
            after = (q << scale) + (before - q * f) + c
            state = after if all_used[step] else np.where(now, after, state)
            if step % CHECKPOINT_STEPS == 0:
                marks[step] = state
        out = []
        for b, size in enumerate(sizes):
            before = np.append(0, np.cumsum(sent[b].sum(1)))
            own = [s for s in sorted(marks) if s * LANES < size]
            stream = words[b][sent[b]]
            crc = zlib.crc32(ids[b * BLOCK : b * BLOCK + size].astype("<u4").tobytes())
            out.append(np.array([size, len(stream), crc, len(own)], "<u4").tobytes())
            out += [np.array([before[s]], "<u4").tobytes() + marks[s][b].astype("<u8").tobytes() for s in own]
            out.append(stream.astype("<u4").tobytes())
        return b"".join(out)

    def decode(self, payload: bytes) -> np.ndarray:
        if self.slot is None:
            self.slot = np.repeat(np.arange(len(self.f)), self.counts)
        sizes, crcs, states, pointer, length, streams, base, at = [], [], [], [], [], [], 0, 0
        while at < len(payload):
            size, n_words, crc, marks = np.frombuffer(payload, "<u4", 4, at).tolist()
            at += 16
            for k in range(marks):
                pointer.append(base + int(np.frombuffer(payload, "<u4", 1, at)[0]))
                states.append(np.frombuffer(payload, "<u8", LANES, at + 4))
                length.append(min(CHECKPOINT_STEPS * LANES, size - k * CHECKPOINT_STEPS * LANES))
                at += 4 + 8 * LANES
            streams.append(np.frombuffer(payload, "<u4", n_words, at))
            at += 4 * n_words
            base += n_words
            sizes.append(size)
            crcs.append(crc)
        if not sizes:
            return np.zeros(0, np.int64)
        state, words = np.array(states, np.uint64), np.append(np.concatenate(streams), np.uint32(0)).astype(np.uint64)
        next_, length = np.array(pointer, np.int64), np.array(length)
        out = np.zeros((len(state), CHECKPOINT_STEPS, LANES), np.int64)
        mask, scale, by32 = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
        lanes = np.arange(LANES)
        for step in range(-(-int(length.max()) // LANES)):
            now = step * LANES + lanes[None, :] < length[:, None]
            low = state & mask
            ids = self.slot[low.astype(np.int64)]
            out[:, step] = ids
            state = np.where(now, self.f[ids] * (state >> scale) + low - self.c[ids], state)
            empty = now & (state < _LOW)
            place = np.minimum(next_[:, None] + np.cumsum(empty, 1) - 1, len(words) - 1)
            state = np.where(empty, (state << by32) | words[np.maximum(place, 0)], state)
            next_ = next_ + empty.sum(1)
        ids = np.concatenate([row.reshape(-1)[:n] for row, n in zip(out, length.tolist())])
        ends = np.cumsum(sizes)
        for a, b, crc in zip((ends - sizes).tolist(), ends.tolist(), crcs):
            if zlib.crc32(ids[a:b].astype("<u4").tobytes()) != crc:
                raise ValueError("a block's checksum does not agree")
        return ids


def _coded(frequencies: np.ndarray, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequencies)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                payload = coder.encode(np.frombuffer(one.column("ids")[0].as_buffer(), dtype))
                yield one.set_column(one.schema.get_field_index("ids"), "payload", pa.array([payload], pa.binary()))

    return run


def write_token_files(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Tokenise every text and write ``path``/blocks (the units) and ``path``/table (the shared frequencies)."""
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = F.col("doc_id"), F.xxhash64("text")  # rows that share an id, or have none, are many tasks' work too
    dealt = columns.repartitionByRange(*order).sortWithinPartitions(*order)
    units = materialise(dealt.mapInArrow(_tokenised(tokenizer), f"{_UNITS}, ids binary, counts binary"), f"{path}/ids")
    counts = np.zeros(size, np.int64)
    for row in units.filter("counts is not null").select("counts").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]  # a row an id of the vocabulary at most
    frequencies = scaled(counts)
    table = [(int(i), int(frequencies[i])) for i in np.flatnonzero(frequencies)]
    docs.sparkSession.createDataFrame(table, "id long, frequency long").coalesce(1).write.mode("overwrite").parquet(f"{path}/table")
    units.drop("counts").mapInArrow(_coded(frequencies, dtype), f"{_UNITS}, payload binary").write.mode("overwrite").parquet(f"{path}/blocks")
    drop(docs.sparkSession, f"{path}/ids")


def _decoded(frequencies: np.ndarray, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequencies)
        for batch in batches:
            for row in range(batch.num_rows):
                part, unit, docs, lengths = (batch.column(c)[row].as_py() for c in ("part", "unit", "doc_ids", "lengths"))
                ids = coder.decode(batch.column("payload")[row].as_buffer())
                ends = np.cumsum(np.array(lengths, np.int64))
                starts = ends - lengths
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array([part] * len(docs), pa.int32()), pa.array([unit] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(starts), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                names = ["part", "unit", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a:b] for a, b in zip(starts.tolist(), ends.tolist())], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    return run


def read_token_files(spark, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    table = spark.read.parquet(f"{path}/table").collect()  # a row an id of the vocabulary at most
    frequencies = np.zeros(max((r["id"] for r in table), default=0) + 1, np.int64)
    for r in table:
        frequencies[r["id"]] = r["frequency"]
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    part_start = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("unit")) - F.col("n_ids")
    units = blocks.select("part", "unit", "n_ids").withColumn("own", own).join(part_start, "part").select("part", "unit", (F.col("part_start") + F.col("own")).alias("unit_start"))
    schema = "part int, unit int, doc_id long, inside long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    docs = blocks.mapInArrow(_decoded(frequencies, with_ids), schema).join(units, ["part", "unit"])
    return docs.select("doc_id", (F.col("unit_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_index(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files into the shared folder, read them back, and return each document's place and checksum."""
    path = f"{shared_dir(docs.sparkSession)}/tokens"
    write_token_files(docs, tokenizer, path)
    return read_token_files(docs.sparkSession, path)

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ..session import drop as drop
from ..session import shared_dir as shared_dir

#: White space of the word contracts; ``bytes.split()`` splits on exactly these six.
BLANKS = b" \t\n\r\x0b\x0c"
WORD_REGEX = r"[^\x20\x09-\x0D]+"

#: Maps A-Z to a-z and every byte that is no ASCII letter, digit or non-ASCII byte to a space.
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet under a shared path and read it back: cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def blocks(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into small ones, so that memory follows a few hundred texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class WordHash(dict):
    """Word to 64-bit hash; remembers the words it has met, up to a bound."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_STEP = 0xD1342543DE82EF95


class Rolling:
    """Polynomial hashes of all windows of a word-hash array, modulo 2**64."""

    def __init__(self) -> None:
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        size = max(n + 1, 2 * len(self.power))
        base, inv = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base)]), dtype=np.uint64)
        self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inv)]), dtype=np.uint64)

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes)
        if n >= len(self.power):
            self._grow(n)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.power[:n], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Hash of each run of ``width`` words, mixed; empty if the text is shorter."""
        n = len(prefix) - 1 - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((prefix[width:] - prefix[:n]) * self.inverse[:n])


class WordKeys:
    """64-bit keys of the words of many texts at once: words are runs of anything but the six blanks."""

    LONG = 256  # longer words are hashed one by one
    AT_ONCE = 1 << 18

    def __init__(self) -> None:
        self.rolling = Rolling()
        self.blanks = re.compile(b"[" + BLANKS + b"]")
        self.blank = np.zeros(256, bool)
        self.blank[list(BLANKS)] = True

    @staticmethod
    def of(word: bytes) -> int:
        """The key of one word."""
        if len(word) > WordKeys.LONG:
            return xxhash.xxh3_64_intdigest(word)
        value = sum((c + 1) * pow(_BASE, i, 1 << 64) for i, c in enumerate(word)) + len(word) * _STEP & (1 << 64) - 1
        return int(mix(np.array([value], np.uint64))[0])

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all words, text after text, and the number of words of each text."""
        keys, counts, owners, held, size = [np.zeros(0, np.uint64)], [], [], [], 0

        def flush() -> None:
            nonlocal held, size
            if held:
                self._hash(held, keys, counts)
            held, size = [], 0

        for i, text in enumerate(texts):
            for piece in self._pieces(text):
                owners.append(i)
                if len(piece) > 4 * self.AT_ONCE:  # it has a very long word
                    flush()
                    words = piece.split()
                    keys.append(np.array([self.of(w) for w in words], np.uint64))
                    counts.append([len(words)])
                    continue
                held.append(piece)
                size += len(piece)
                if size >= self.AT_ONCE:
                    flush()
        flush()
        total = np.zeros(len(texts), np.int64)
        if owners:
            np.add.at(total, owners, np.concatenate(counts).astype(np.int64))
        return np.concatenate(keys), total

    def _pieces(self, text: bytes) -> Iterator[bytes]:
        """A text cut at blanks into pieces of about AT_ONCE bytes, so that memory does not follow its length."""
        at = 0
        while len(text) - at > self.AT_ONCE and (found := self.blanks.search(text, at + self.AT_ONCE)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def _hash(self, texts: list[bytes], keys: list, counts: list) -> None:
        data = b" " + b" ".join(texts) + b" "
        codes = np.frombuffer(data, np.uint8)
        edges = np.flatnonzero(np.diff(self.blank[codes].view(np.int8)))
        start, end = edges[::2] + 1, edges[1::2] + 1
        sums, inverse = self.rolling.prefix(codes.astype(np.uint64) + np.uint64(1)), self.rolling.inverse
        found = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(_STEP))
        for i in np.flatnonzero(end - start > self.LONG).tolist():
            found[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
        last = np.cumsum(np.array([len(t) for t in texts], np.int64) + 1)
        keys.append(found)
        counts.append(np.diff(np.searchsorted(start, last), prepend=0))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

"""What several operators share: the shared folder, written tables, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from memlake.operators.components import connected_components
from memlake.storage import materialize, new_path, shared_dir

__all__ = ["CACHED", "LONGEST", "WORD", "Hashes", "connected_components", "materialize", "new_path", "raw", "shared_dir", "slices"]

#: Separators of words: space and U+0009 to U+000D. `bytes.split()` splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


#: Entries that a worker's table of words holds before it starts anew, and the bytes of the longest word that it holds; bounds on
#: memory, without effect on results.
CACHED, LONGEST = 1 << 18, 64


class Hashes(dict):
    """64-bit hash of each word (bytes), kept for the words that come again."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that what is made of the texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; of null, none."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]

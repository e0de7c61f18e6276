"""Lookup of the strings of Arrow batches in a table that each task holds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc


class Lookup:
    """Index of each string in words, -1 for others and nulls. The table is built once; of a batch only its distinct strings are looked up."""

    def __init__(self, words: list[str]):
        self.at = {w: i for i, w in enumerate(words)}

    def __call__(self, values: pa.Array) -> np.ndarray:
        own = values.cast(pa.string()).dictionary_encode()
        at = np.fromiter((self.at.get(w, -1) for w in own.dictionary.to_pylist()), np.int64, len(own.dictionary))
        index = own.indices.fill_null(len(at)).to_numpy(zero_copy_only=False)
        return np.append(at, -1)[index]


def _hashes(words: pa.Array, step: int = 100_000) -> np.ndarray:
    parts = [pd.util.hash_array(words.slice(k, step).to_numpy(zero_copy_only=False), categorize=False) for k in range(0, len(words), step)]
    return np.concatenate([*parts, np.zeros(0, np.uint64)])


class HashedLookup:
    """The same for many distinct words, made once and sent to the tasks.

    The words are one Arrow array with sorted hashes, 12 bytes each beside the strings; a string is found by its hash and then compared.
    """

    def __init__(self, words: pa.Array):
        self.words = words
        hashes = _hashes(self.words)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.order = hashes[order], order.astype(np.int32)
        same = np.flatnonzero(self.hashes[1:] == self.hashes[:-1]) + 1
        #: words that come behind another one with their hash
        self.behind = {self.words[i].as_py(): i for i in order[same].tolist()}

    def __call__(self, values: pa.Array) -> np.ndarray:
        own = values.cast(pa.string()).dictionary_encode()
        words = own.dictionary
        at = np.full(len(words), -1, np.int64)
        if len(self.order) and len(words):
            found = self.order[np.minimum(np.searchsorted(self.hashes, _hashes(words)), len(self.order) - 1)]
            same = pc.equal(self.words.take(pa.array(found)), words).to_numpy(zero_copy_only=False)
            at[same] = found[same]
            if self.behind:
                for i in np.flatnonzero(~same).tolist():
                    at[i] = self.behind.get(words[i].as_py(), -1)
        index = own.indices.fill_null(len(at)).to_numpy(zero_copy_only=False)
        return np.append(at, -1)[index]

"""One-permutation MinHash with optimal densification, on 64-bit shingle hashes."""

from __future__ import annotations

import numpy as np

from rainloom.llm import common

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending; a text of fewer words is one shingle, without words none."""
    words, upto = common.word_hashes(texts, "space")
    shingles = common.shingle_hashes(words, size)
    out = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(shingles[a:b - size + 1]))
        elif b > a:
            whole = words[a:a + 1]
            for w in words[a + 1:b]:
                whole = common.mix(whole * np.uint64(5) + w)
            out.append(common.mix(whole + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of ``bins`` minima per non-empty set.

    One permutation deals the hashes into bins and keeps the least of each.  An
    empty bin takes the value of another, found by hashing (bin, attempt) until
    one that is not empty comes up (optimal densification): the probe sequence
    is the same for all sets, so that similar sets borrow alike.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    permuted = common.mix(np.concatenate(sets) ^ np.uint64(0xA24BAED4963EE407)) if len(owner) else np.empty(0, np.uint64)
    own = np.full(len(sets) * bins, EMPTY)
    place = ((permuted >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    np.minimum.at(own, owner * bins + place.astype(np.int64), permuted)
    own = own.reshape(len(sets), bins)
    out = own.copy()
    row, column = np.nonzero(out == EMPTY)
    attempt = 0
    while len(row):
        attempt += 1
        probe = (common.mix(column.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        value = own[row, probe]
        taken = value != EMPTY
        out[row[taken], column[taken]] = value[taken]
        row, column = row[~taken], column[~taken]
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per row and band: the band's number and all its bins."""
    rows = signature.reshape(len(signature), bands, signature.shape[1] // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03), rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        key = common.mix(key * np.uint64(3) + rows[:, :, k])
    return key.view(np.int64)

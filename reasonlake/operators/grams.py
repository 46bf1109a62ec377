"""Pieces of texts as numbers: which entries of a large dictionary may be in a chunk of texts."""

from __future__ import annotations

import numpy as np

#: Lengths of the pieces, each twice the one before. A literal is looked up by pieces of the longest kind that fits.
KINDS = (1, 2, 4, 8)
#: Buckets in which pieces of entries are counted, and bits of the sieve of wanted pieces, both as powers of two. More entries let
#: more pieces through, none is lost.
COUNTED, SIEVE = 22, 27
#: Characters of a text that are taken at a time.
STEP = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def pieces(text: np.ndarray) -> list[np.ndarray]:
    """For each kind a number of the piece that starts at each place; pieces of a kind are made of two of the kind before."""
    out, now, half = [], (text + np.uint64(1)) * _MIX, 1
    for kind in KINDS:
        if kind > 1:
            n = max(len(now) - half, 0)
            now, half = now[:n] * _MIX + (now[half : half + n] ^ np.uint64(kind)), kind
        now = now ^ (now >> np.uint64(29))
        out.append(now * _MIX)
    return out


def of_literals(literals: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(literal's number, piece): all pieces by which the literals, none of them empty, can be looked up."""
    made = pieces(codes("".join(literals)))
    lengths = np.array([len(x) for x in literals], np.int64)
    starts = np.cumsum(lengths) - lengths
    owners, found = [], []
    for i, kind in enumerate(KINDS):
        own = np.flatnonzero((lengths >= kind) & (lengths < (2 * kind if kind < KINDS[-1] else 1 << 62)))
        n = lengths[own] - kind + 1
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owners.append(np.repeat(own, n))
        found.append(made[i][np.repeat(starts[own], n) + within])
    return np.concatenate(owners), np.concatenate(found)


def bucket(piece: np.ndarray, bits: int) -> np.ndarray:
    return (piece >> np.uint64(64 - bits)).astype(np.int64)


def rarest(literals: list[str], counts: np.ndarray) -> np.ndarray:
    """The piece of each literal that fewest entries have, by the counts of buckets."""
    owner, piece = of_literals(literals)
    order = np.lexsort((piece, counts[bucket(piece, COUNTED)], owner))
    first = np.ones(len(order), bool)
    first[1:] = owner[order][1:] != owner[order][:-1]
    return piece[order][first]


def sifted(text: str, sieve: np.ndarray) -> np.ndarray:
    """Distinct pieces of a text that the sieve (words of 64 bits) lets through."""
    kept = []
    for start in range(0, len(text), STEP):
        for piece in pieces(codes(text[start : start + STEP + KINDS[-1] - 1])):
            at = bucket(piece, SIEVE)
            kept.append(piece[(sieve[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1])
    return np.unique(np.concatenate(kept)) if kept else np.array([], np.uint64)

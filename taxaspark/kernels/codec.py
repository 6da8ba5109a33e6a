"""Packed model bytes: 13-bit mantissa and 3-bit exponent per value.

Layout: 4 bytes of flags and alphabet, 4 bytes of size, then negated logs of the moves DD,
MD, MM, IM, of the emissions but for the last residue, and of the background.  The other
moves and the last residue follow from the rest, since probabilities sum to 1.
"""

from __future__ import annotations

import numpy as np

from .phmm import DD, DI, DM, ID, II, IM, LOW, MD, MI, MM, Phmm

# Scale of the mantissa, smallest and largest value that can be packed.
SCALE = 0.9102122
SMALLEST, LARGEST = 1e-6, 100.0


def pack_values(x: np.ndarray) -> np.ndarray:
    """uint16 codes of values from 1e-6 up to (not including) 100; others raise an error."""
    x = np.asarray(x, float)
    if not np.isfinite(x).all() or (x < SMALLEST).any() or (x >= LARGEST).any():
        raise ValueError("values must be finite, at least 1e-6 and below 100")
    exponent = np.clip(np.floor(np.log10(x)).astype(int), -6, 1)
    mantissa = np.clip(np.round((x / 10.0**exponent - 1) * 1000 * SCALE), 0, (1 << 13) - 1).astype(int)
    return ((exponent + 6) << 13 | mantissa).astype(np.uint16)


def unpack_values(codes: np.ndarray) -> np.ndarray:
    c = np.asarray(codes).astype(int)
    return ((c & ((1 << 13) - 1)) / (1000 * SCALE) + 1) * 10.0 ** ((c >> 13) - 6)


def _safe(x: np.ndarray) -> np.ndarray:
    return np.clip(-x, SMALLEST, LARGEST * 0.999)


def encode_phmm(model: Phmm) -> bytes:
    """The packed form; a forbidden move is stored as the largest value."""
    head = np.array([1 if model.e.shape[0] == 20 else 0, model.size], np.int32).tobytes()
    values = np.concatenate([_safe(model.a[r]) for r in (DD, MD, MM, IM)] + [_safe(model.e[:-1]).ravel(), _safe(model.qe)])
    return head + pack_values(values).tobytes()


def decode_phmm(blob: bytes) -> Phmm:
    amino, size = np.frombuffer(blob, np.int32, 2).tolist()
    letters = 20 if amino else 4
    v = -unpack_values(np.frombuffer(blob, np.uint16, offset=8))
    v[v <= -99] = LOW
    n = size + 1
    a = np.full((9, n), LOW)
    for k, r in enumerate((DD, MD, MM, IM)):
        a[r] = v[k * n : (k + 1) * n]
    rest = lambda *logs: np.log(np.maximum(1 - sum(np.exp(x) for x in logs), 1e-6))
    a[MI] = rest(a[MD], a[MM])
    share = np.maximum(1 - np.exp(a[DD]), 1e-6)
    a[DM], a[DI] = np.log(share * 6 / 7), np.log(share / 7)
    share = np.maximum(1 - np.exp(a[IM]), 1e-6)
    a[ID], a[II] = np.log(share / 4), np.log(share * 3 / 4)
    a[:3, 0] = LOW
    for into, out in ((DD, DI), (MD, MI), (ID, II)):
        a[into, size] = LOW
        a[out, size] = rest(a[{DD: DM, MD: MM, ID: IM}[into], size])
    a[DM, size], a[DI, size] = np.log(6 / 7), np.log(1 / 7)
    e = v[4 * n : 4 * n + (letters - 1) * size].reshape(letters - 1, size)
    e = np.vstack((e, rest(*e))) if letters > 1 else e
    qe = v[4 * n + (letters - 1) * size :]
    return Phmm(size, a, e, np.zeros(9), qe)

"""CRC-32 of any stretch of bytes from two running CRCs, in numpy.

The CRC register is linear over GF(2): the register after a prefix, moved on by as many
zero bytes as follow it, is what the prefix adds to the register after a longer one.  So
two running registers and one such shift give the CRC of the bytes between them, as
long as they may be, and texts are scanned once for n-grams of all lengths.
"""

from __future__ import annotations

import numpy as np

#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
FULL = np.uint32(0xFFFFFFFF)
#: Bytes of a row that are scanned one after another, all rows at once; shifts below STEPS bytes have a table each.
ROW = 64
STEPS = 256


def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


TABLE = _table()


def _moved(register: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Registers through one shift, given as four tables by the value of a byte."""
    return by[0][register & 255] ^ by[1][register >> 8 & 255] ^ by[2][register >> 16 & 255] ^ by[3][register >> 24]


def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """The shifts by 0 .. STEPS - 1 zero bytes, and those by STEPS times 1, 2, 4, ..."""
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    small = []
    for _ in range(STEPS):
        small.append(now)
        now = TABLE[now & 255] ^ now >> 8
    powers = []
    for _ in range(40):
        powers.append(now)
        now = _moved(now, now)
    return np.stack(small), powers


SMALL, POWERS = _shifts()


def shifted(register: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Registers moved on by so many zero bytes each."""
    low = by % STEPS
    out = SMALL[low, 0, register & 255] ^ SMALL[low, 1, register >> 8 & 255] ^ SMALL[low, 2, register >> 16 & 255] ^ SMALL[low, 3, register >> 24]
    high = by // STEPS
    k = 0
    while high.any():
        own = np.flatnonzero(high & 1)
        out[own] = _moved(out[own], POWERS[k])
        high, k = high >> 1, k + 1
    return out


class Prefixes:
    """The running registers of a byte string, kept by row with what enters each row."""

    def __init__(self, data: np.ndarray):
        rows = max(1, -(-len(data) // ROW))
        full = np.zeros(rows * ROW, np.uint8)
        full[: len(data)] = data
        columns = np.ascontiguousarray(full.reshape(rows, ROW).T).astype(np.uint32)
        register = np.zeros(rows, np.uint32)
        self.after = np.empty((ROW, rows), np.uint32)
        for k in range(ROW):
            register = TABLE[(register ^ columns[k]) & 255] ^ register >> 8
            self.after[k] = register
        # what enters a row: all rows before it, summed by doubling
        total, gap, by = register.copy(), 1, SMALL[ROW]
        while gap < rows:
            total[gap:] ^= _moved(total[:-gap], by)
            gap, by = 2 * gap, _moved(by, by)
        self.enter = np.concatenate([np.zeros(1, np.uint32), total[:-1]])

    def at(self, length: np.ndarray) -> np.ndarray:
        """The register after so many first bytes, from a register of zero."""
        row, col = np.divmod(np.maximum(length, 1) - 1, ROW)
        return np.where(length > 0, self.after[col, row] ^ shifted(self.enter[row], col + 1), np.uint32(0))

    def crc(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """CRC-32 of the bytes from begin to before end."""
        return self.at(end) ^ shifted(self.at(begin) ^ FULL, end - begin) ^ FULL

"""Terms of whole texts, cut out of a batch at once: runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256, dtype=np.uint8)
_IS_UPPER = (_BYTES >= ord("A")) & (_BYTES <= ord("Z"))
_LOWER = np.where(_IS_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
_IS_TERM = (
    ((_LOWER >= ord("a")) & (_LOWER <= ord("z"))) | ((_BYTES >= ord("0")) & (_BYTES <= ord("9"))) | (_BYTES >= 0x80)
)


class Terms(NamedTuple):
    names: pa.Array  # the different terms, as UTF-8
    codes: np.ndarray  # the number of each term of the batch, text after text
    counts: np.ndarray  # how many of them each text has


def terms(texts: pa.Array) -> Terms:
    """The terms of some texts. A null text has none. On bytes: a character beyond ASCII is bytes from 0x80 on."""
    whole = texts.cast(pa.large_binary()).fill_null(b"")
    _, ends, data = whole.buffers()
    offsets = np.frombuffer(ends, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = _IS_TERM[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begun = offsets[:-1][offsets[:-1] < len(raw)]
    first[begun] = inside[begun]
    starts = np.flatnonzero(first)
    kept = _LOWER[raw[inside]]
    upto = (np.cumsum(inside)[starts] - 1) if len(starts) else np.zeros(0, np.int64)
    cuts = np.append(upto, len(kept)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(kept)])
    coded = found.dictionary_encode()
    return Terms(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.diff(np.searchsorted(starts, offsets)))


def terms_of(text: str | None) -> list[bytes]:
    """The same for one text."""
    names, codes, _ = terms(pa.array([text], pa.string()))
    listed = names.to_pylist()
    return [listed[c] for c in codes.tolist()]

"""Words of whole Arrow batches of texts, found at once; the same words as those of functions.text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import KEYWORD_STOP

#: Bytes of keyword words in their lower case, all others as a space.
KEYWORD_BYTES = bytes(ord(chr(b).lower()) if b < 128 and (chr(b).isalnum() or chr(b) in "_'") else 32 for b in range(256))


def _kept(lists: pa.ListArray, keep: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(keep))[lists.offsets.to_numpy()].astype(np.int32)), lists.values.filter(pa.array(keep)))


def _plain(texts: pa.Array) -> pa.StringArray:
    """texts in keyword words and spaces."""
    texts = texts.fill_null("")
    if not len(texts):
        return texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = data.slice(at[0], at[-1] - at[0]).to_pybytes() if data is not None else b""
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(raw.translate(KEYWORD_BYTES)))


def spaced(texts: pa.Array) -> pa.ListArray:
    """The words between white space, unchanged."""
    found = pc.ascii_split_whitespace(texts.fill_null(""))
    return _kept(found, pc.binary_length(found.values).to_numpy() > 0)


def keywords(texts: pa.Array) -> pa.ListArray:
    """The words for keyword search, as functions.text.keyword_tokens finds them."""
    found = pc.ascii_split_whitespace(_plain(texts))
    stop = pc.index_in(found.values, value_set=pa.array(KEYWORD_STOP)).is_valid().to_numpy(zero_copy_only=False)
    return _kept(found, (pc.binary_length(found.values).to_numpy() >= 2) & ~stop)


def phrase(text: str) -> str:
    """All words of one text, as functions.text.keyword_phrase gives them."""
    return phrases(pa.array([text], pa.string()))[0].as_py()


def phrases(texts: pa.Array) -> pa.StringArray:
    """All words of each text, as functions.text.keyword_phrase gives them."""
    return pc.binary_join(spaced(_plain(texts)), " ")


def windows(texts: pa.Array, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """(row, window, words of the row, text): ``size`` words each, ``step`` words on, joined by one space; none for a text without words."""
    words = spaced(texts)
    at = words.offsets.to_numpy().astype(np.int64)
    n = np.diff(at)
    k = np.where(n > 0, np.maximum(0, -((size - n) // step)) + 1, 0)
    row = np.repeat(np.arange(len(n)), k)
    window = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
    start = at[row] + window * step
    length = np.minimum(size, at[row + 1] - start)
    ends = np.cumsum(length)
    each = np.repeat(start - ends + length, length) + np.arange(length.sum())
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), words.values.take(pa.array(each)))
    return row, window, n[row], pc.binary_join(lists, " ")

"""BPE encoding and decoding with content-defined chunk reuse.

A gear hash over the bytes cuts a text where its low bits are zero, so equal passages get equal chunks wherever
they stand. A worker process encodes each distinct chunk once and keeps it in a bounded cache that outlives the
task. A cut can fall anywhere, so chunk joins are repaired: the tokens around a cut are encoded again from text
that reaches a little to the left and right, and wider and wider, until the new tokens agree with the cached
ones at both ends at places where no token can span. The result is exactly that of encoding the whole text.

Why agreement proves exactness: the splitting pattern never matches across a place with a non-space before it
and white space after it, or a letter before and punctuation after it, nor does it look back, so text on either
side of such a place encodes independently. A chunk without such a place joins the next one.

Chunks of letters that all Unicode versions in use class alike (below U+0530) are encoded with the rank file of the
same vocabulary, all others with the tokenizer file itself. Texts with a special token's string are cut there first.
Decoding sends ids through a byte table; invalid UTF-8 becomes U+FFFD as the library does.

Nulls are empty texts: no ids. Each row gets a row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

CHUNK_BITS = 9
CACHE_BYTES = 48 << 20
_GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint64)
_WINDOW = 32
#: Places that no token of the byte-level pattern spans: a non-space before white space, a letter before punctuation.
#: Only characters that every Unicode version in use puts in the same class count.
_SAFE = re.compile("(?<=[^\\s\x1c-\x1f\u180e\u200b\ufeff])(?=[\x09-\x0d ])|(?<=[A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])(?=[,.;:!?\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")
_PLAIN = re.compile("[\x09-\x0d\x20-\x7e\xa1-ͷЀ-ԯ]*")


class Codec:
    """A byte-level BPE tokenizer file, its rank file if there is one, and the cache of encoded chunks."""

    def __init__(self, json_path: str, ranks_path: str | None, cache_bytes: int = CACHE_BYTES, plain: bool = False):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.slow.encode_special_tokens = plain
        with open(json_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special and not plain else None
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = self._byte_table(spec)
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.cache: OrderedDict[str, np.ndarray] = OrderedDict()
        self.room, self.encoded, self.reused = cache_bytes, 0, 0

    @staticmethod
    def _byte_table(spec: dict) -> list[bytes]:
        """The bytes of each id. Printable bytes stand for themselves in the vocabulary, the rest from U+0100 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        out = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            out[i] = token.encode() if token in added else bytes(back[c] for c in token)
        for token, i in added.items():
            out[i] = token.encode()
        return out

    def direct(self, text: str) -> np.ndarray:
        """Ids of a text without special tokens, by a library."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is not None and len(text) < 100_000 and _PLAIN.fullmatch(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def chunk(self, text: str) -> np.ndarray:
        got = self.cache.get(text)
        if got is not None:
            self.reused += 1
            self.cache.move_to_end(text)
            return got
        self.encoded += 1
        got = self.direct(text)
        self.cache[text] = got
        self.room -= 4 * len(text) + got.nbytes + 200
        while self.room < 0 and self.cache:
            k, v = self.cache.popitem(last=False)
            self.room += 4 * len(k) + v.nbytes + 200
        return got

    def _parts(self, text: str) -> list[str]:
        """Content-defined chunks: a cut depends on the bytes before it alone."""
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) < 2 << CHUNK_BITS:
            return [text]
        g, n = _GEAR[raw], len(raw)
        h, width = g.copy(), 1  # h[i]: sum of gear values of the last 32 bytes, shifted by their distance
        while width < _WINDOW:
            h[width:] = h[width:] + (h[:-width] << np.uint64(width))
            width *= 2
        at = np.flatnonzero((h >> np.uint64(23)) & np.uint64((1 << CHUNK_BITS) - 1) == 0) + 1
        first = (raw & 0xC0) != 0x80  # bytes at which a character begins
        at = at[(at < n)]
        at = at[first[at]]
        if not len(at):
            return [text]
        cuts = at.tolist() if len(raw) == len(text) else np.cumsum(first)[at - 1].tolist()
        out, start = [], 0
        for cut in cuts:
            if _SAFE.search(text, start + 1, cut):
                out.append(text[start:cut])
                start = cut
        return [*out, text[start:]]

    def _segment(self, text: str) -> list[np.ndarray]:
        parts = self._parts(text)
        out, done = [self.chunk(parts[0])], len(parts[0])
        for part in parts[1:]:  # out: the exact ids of text[:done]
            ids, reach = self.chunk(part), 1
            while True:
                left, right = _left(text, done, reach), _right(text, done, done + len(part), reach)
                head, tail = self._head(out, len(text[left:done].encode())), self._tail(ids, len(text[done:right].encode()))
                if head is not None and tail is not None:
                    break
                reach *= 2  # at last the whole text and the whole part
            keep, piece = head
            del out[keep:]
            out += [x for x in (piece, self.direct(text[left:right]), tail) if len(x)]
            done += len(part)
        return out

    def _head(self, out: list[np.ndarray], drop: int) -> tuple[int, np.ndarray] | None:
        """How many arrays, and which ids of the next, are left without the last ``drop`` bytes; None if an id spans that place."""
        for k in range(len(out) - 1, -1, -1):
            ends = np.cumsum(self.length[out[k]])
            if (rest := int(ends[-1]) - drop) > 0:
                i = int(np.searchsorted(ends, rest))
                return (k, out[k][: i + 1]) if ends[i] == rest else None
            drop = -rest
            if not drop:
                return k, out[k][:0]
        return 0, np.zeros(0, np.uint32)

    def _tail(self, ids: np.ndarray, drop: int) -> np.ndarray | None:
        """The ids without the first ``drop`` bytes; None if an id spans that place."""
        ends = np.cumsum(self.length[ids])
        i = int(np.searchsorted(ends, drop))
        return ids[i + 1 :] if i < len(ends) and ends[i] == drop else None

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.cut is None or not self.cut.search(text):
            return np.concatenate(self._segment(text))
        out = []
        for piece in self.cut.split(text):
            if piece in self.special:
                out.append(np.array([self.special[piece]], np.uint32))
            elif piece:
                out += self._segment(piece)
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


def _left(text: str, at: int, reach: int) -> int:
    """The ``reach``-th safe place before ``at``, or the start of the text."""
    span = 64 * reach
    while True:
        found = [m.start() for m in _SAFE.finditer(text, max(0, at - span), at) if m.start() < at and m.start() > max(0, at - span)]
        if len(found) >= reach:
            return found[-reach]
        if span >= at:
            return 0
        span *= 4


def _right(text: str, at: int, end: int, reach: int) -> int:
    """The ``reach``-th safe place after ``at``, or ``end``."""
    for m in _SAFE.finditer(text, at + 1, end):
        if m.start() < end:
            reach -= 1
            if not reach:
                return m.start()
    return end


_CODECS: dict[tuple, Codec] = {}


def codec(json_path: str | None = None, ranks_path: str | None = None, plain: bool = False) -> Codec:
    """The process's codec; its cache lives as long as the worker. Paths default to the public byte-level files.

    plain: strings of special tokens are ordinary text.
    """
    key = (json_path, ranks_path, plain)
    if key not in _CODECS:
        if json_path is None:
            import public_tokenizers

            json_path, ranks_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
        _CODECS[key] = Codec(json_path, ranks_path, plain=plain)
    return _CODECS[key]


def encode_decode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, ranks_path: str | None = None, digest: bool = False) -> DataFrame:
    """For each row: its id, n_tokens and the ids and decoded text, or their digests. No shuffle."""

    def of(batches):
        c = codec(json_path, ranks_path)
        for b in batches:
            for s in slices(b):
                n, first, second = [], [], []
                for t in s.column(1).to_pylist():
                    ids = c.encode(t)
                    text = c.decode(ids)
                    n.append(len(ids))
                    if digest:
                        first.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                        second.append(hashlib.sha256(text.encode()).hexdigest())
                    else:
                        first.append(ids.astype(np.int32))
                        second.append(text)
                kind = pa.string() if digest else pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(n, pa.int64()), pa.array(first, kind), pa.array(second, pa.string())], names=names)

    small_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, f"doc_id long, n_tokens long, {names[2]} {'string' if digest else 'array<int>'}, {names[3]} string")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """op5 over the whole of documents: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)

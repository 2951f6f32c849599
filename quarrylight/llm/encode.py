"""Encoding of texts with a public byte-level BPE vocabulary, by forced boundaries.

A byte pair that occurs inside no token of the vocabulary always has a token boundary between its bytes. Texts are cut at
such pairs, fragments are encoded independently, each distinct fragment once per worker, and the ids are joined again.

A cut must also leave the pre-splitting pattern's choices as they are in the whole text. It does if the left byte is a
printable ASCII character other than white space (the pattern looks ahead at white space only, and a run that a cut
divides is matched by the same alternative on both sides), the right byte begins a character, and the right character is
no apostrophe after a sign: there ``'s`` at a fragment's start would be a contraction that the whole text has not.

Defined results: a null or empty text gives the empty list; strings that look like special tokens are ordinary text;
row order and repeated rows stay; columns other than the two named ones are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow

#: Splits text before the merges of the vocabulary (fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct fragments that a worker remembers before it starts anew.
REMEMBERED = 300_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 token and id on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def cut_table(tokens: Iterable[bytes]) -> np.ndarray:
    """256 x 256: whether a text may be cut between the two bytes."""
    seen = np.zeros((256, 256), dtype=bool)
    for t in tokens:
        if len(t) > 1:
            a = np.frombuffer(t, dtype=np.uint8)
            seen[a[:-1], a[1:]] = True
    ok = ~seen
    ok[:0x21, :] = False
    ok[0x7F:, :] = False
    ok[:, 0x80:0xC0] = False
    word = np.array([chr(b).isalnum() for b in range(128)] + [False] * 128)
    ok[~word, ord("'")] = False
    return ok


class Encoder:
    """Encodes batches of texts; keeps distinct fragments."""

    def __init__(self, raw: bytes):
        import tiktoken

        ranks = read_ranks(raw)
        self.whole = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cuts = cut_table(ranks)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.starts, self.lens = array("i"), array("q"), array("q")

    def _new(self, fragment: bytes) -> int:
        ids = self.whole.encode_ordinary(fragment.decode("utf-8"))
        self.index[fragment] = at = len(self.starts)
        self.starts.append(len(self.flat))
        self.lens.append(len(ids))
        self.flat.extend(ids)
        return at

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text of a string array."""
        if len(self.index) > REMEMBERED:
            self._clear()
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
        base, data = offsets[0], texts.buffers()[2]
        raw = data.to_pybytes()[base : offsets[-1]] if data is not None else b""
        ends = offsets - base
        a = np.frombuffer(raw, dtype=np.uint8)
        inner = np.flatnonzero(self.cuts[a[:-1], a[1:]]) + 1 if len(a) > 1 else np.zeros(0, dtype=np.int64)
        bounds = np.union1d(inner, ends)
        # distinct fragments are found in compiled code; only they are looked up one by one
        cut = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        get, new = self.index.get, self._new
        known = np.array([i if (i := get(f)) is not None else new(f) for f in cut.dictionary.to_pylist()], dtype=np.int64)
        order = known[cut.indices.to_numpy()]
        flat, starts, lens = (np.frombuffer(x, dtype=d) if len(x) else np.zeros(0, dtype=d) for x, d in ((self.flat, np.int32), (self.starts, np.int64), (self.lens, np.int64)))
        n = lens[order]
        after = np.concatenate(([0], np.cumsum(n)))
        where = np.repeat(starts[order] - after[:-1], n) + np.arange(after[-1])
        values = flat[where].copy()
        del flat, starts, lens  # the arrays can't grow while views of them live
        return pa.ListArray.from_arrays(pa.array(after[np.searchsorted(bounds, ends)], type=pa.int32()), pa.array(values, type=pa.int32()))


_encoders: dict[str, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """The worker's encoder of a vocabulary, built once."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(raw)
    return _encoders[key]


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns ``doc_id`` and ``ids`` of every row.

    The vocabulary is read by the driver and sent to the workers: its size is that of a public vocabulary file
    (under 1 MB here) and doesn't grow with the texts.
    """
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), known.encode(b.column(1))], names=["doc_id", "ids"])

    return map_arrow(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")), run, "doc_id bigint, ids array<int>")

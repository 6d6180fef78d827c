"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over `HASH_BYTES` bytes cuts every text into chunks, so a passage that several documents share is
cut alike in each of them. A chunk is encoded once and kept in a bounded store of the worker; later documents
reuse its ids. The ids at a chunk join can differ from those of the whole text, so each join is repaired: the
text between the last sure boundary before the join and the first one after it is encoded again in place of the ids on
both sides. A sure boundary is a visible ASCII character followed by ASCII white space: no
pre-token of the byte-level pattern and no special token reaches over it, in any context, so there the chunk's ids
and those of the whole text agree exactly. A chunk without a sure boundary leaves its join open: it is encoded with its
neighbours, once, when a sure boundary or the text's end comes. So every byte is encoded twice at most.

The vocabulary file is a parameter: a tokenizers JSON of a byte-level BPE whose pre-tokenizer is the byte-level
pattern below, without normaliser or prefix space; anything else is refused. The merges are run by tiktoken from the
same vocabulary.

Defined results: null and empty texts encode to no ids; special-token strings inside a text become their ids, as
the tokenizers library does by default; ids decode to the text again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._text import _BYTE, powers, slices, string_buffers
from ._worker import resident

#: fixed value: the pre-token pattern of byte-level BPE vocabularies
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HASH_BYTES = 16
MEAN_CHUNK = 2048
STORE_BYTES = 24 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_SEEN = np.zeros(256, bool)
_SEEN[0x21:0x7F] = True


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 as itself, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Codec:
    def __init__(self, content: str) -> None:
        import tiktoken

        spec = json.loads(content)
        pre, model = spec["pre_tokenizer"], spec["model"]
        plain = not spec["normalizer"] and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True)
        if not plain or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte-level BPE vocabularies can be used")
        to_byte = _byte_of_char()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"]):
            raise ValueError("special tokens that strip or hold white space can't be used")
        ranks = {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.piece: dict[int, bytes] = {i: b for b, i in ranks.items()} | {i: t.encode() for t, i in added.items()}
        top = max(self.piece) + 1
        self.size = np.array([len(self.piece.get(i, b"")) for i in range(top)])
        self.store: dict[bytes, tuple[np.ndarray, int, int]] = {}
        self.held = 0
        self.reused = self.made = self.repaired = 0

    def _encode(self, raw: bytes) -> np.ndarray:
        return self.coder.encode_to_numpy(raw.decode(), allowed_special="all")

    def chunk(self, raw: bytes, first: int, last: int) -> tuple[np.ndarray, int, int]:
        """Ids of a chunk and those of its ids that lie between its first and last sure boundary (byte places)."""
        hit = self.store.get(raw)
        if hit is None:
            ids = self._encode(raw)
            ends = np.cumsum(self.size[ids])
            i, j = (int(np.searchsorted(ends, x)) + 1 for x in (first, last))
            if ends[i - 1] != first or ends[j - 1] != last:
                raise AssertionError("a token reaches over a sure boundary")
            hit = (ids, i, j)
            self.made += 1
            self.held += len(raw) + ids.nbytes + 300
            while self.held > STORE_BYTES and self.store:  # oldest first
                k = next(iter(self.store))
                self.held -= len(k) + self.store.pop(k)[0].nbytes + 300
            self.store[raw] = hit
        else:
            self.reused += 1
        return hit

    def encode(self, raw: bytes, cuts: list[int], sure: np.ndarray) -> list[int]:
        """Ids of a text; cuts: inner chunk bounds; sure: its sure boundaries (sorted byte positions)."""
        out: list[int] = []
        done = 0  # out has the ids of the bytes before this place, the text's beginning or a sure boundary
        at = [0, *cuts, len(raw)]
        k = np.searchsorted(sure, at)
        for lo, hi, i, j, right in zip(at[:-1], at[1:], k[:-1].tolist(), k[1:].tolist(), np.searchsorted(sure, at[:-1], side="right").tolist(), strict=True):
            i = max(i, right)  # boundaries inside the chunk only
            if i >= j:
                continue
            first, last = int(sure[i]), int(sure[j - 1])
            ids, a, b = self.chunk(raw[lo:hi], first - lo, last - lo)
            if lo == 0:  # nothing comes before
                out += ids[:b].tolist()
            else:
                if done < first:
                    out += self._encode(raw[done:first]).tolist()
                    self.repaired += 1
                out += ids[a:b].tolist()
            done = last
            if hi == len(raw):  # nothing comes after
                out += ids[b:].tolist()
                done = hi
        if done < len(raw):
            out += self._encode(raw[done:]).tolist()
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.piece.__getitem__, ids)).decode("utf-8", "replace")

    def texts(self, col: pa.Array) -> Iterator[list[int]]:
        """Ids of each text of a column."""
        buf, off = string_buffers(col)
        if len(buf) >= HASH_BYTES:
            up, down = powers(len(buf))
            total = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
            h = (total[HASH_BYTES:] - total[:-HASH_BYTES]) * down[: len(buf) - HASH_BYTES + 1]  # a window's hash wherever it lies
            h *= np.uint64(0xBF58476D1CE4E5B9)
            cut = np.flatnonzero(h < np.uint64(2**64 // MEAN_CHUNK)) + HASH_BYTES
            cut = cut[cut < len(buf)]
            cut = cut[(buf[cut] & 0xC0) != 0x80]  # never inside a character
        else:
            cut = np.zeros(0, np.int64)
        sure = np.flatnonzero(_BLANK[buf[1:]] & _SEEN[buf[:-1]]) + 1 if len(buf) else cut
        c, s = np.searchsorted(cut, off), np.searchsorted(sure, off, side="right")
        data = buf.tobytes()
        for i in range(len(off) - 1):
            a, b = int(off[i]), int(off[i + 1])
            inner = cut[c[i] : c[i + 1]] - a
            own = sure[s[i] : s[i + 1]] - a
            yield self.encode(data[a:b], inner[inner > 0].tolist(), own[(own > 0) & (own < b - a)])


def codec(content: str) -> Codec:
    return resident(Codec, content)


def _vocabulary(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:  # the driver's file; executors get its content
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns plus ids_col array<int> (a column of that name is replaced)."""
    vocab, keep = _vocabulary(docs, path), [c for c in docs.columns if c != ids_col]

    def run(batches):
        own = codec(vocab.value)
        for batch in batches:
            for part in slices(batch, text_col):
                ids = list(own.texts(part.column(text_col)))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*keep, ids_col])

    return docs.select(*keep).mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Replaces or adds text_col with the text of ids_col (null ids: empty text)."""
    vocab, keep = _vocabulary(encoded, path), [c for c in encoded.columns if c != text_col]

    def run(batches):
        own = codec(vocab.value)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, text_col])

    return encoded.select(*keep).mapInArrow(run, T.StructType([*(encoded.schema[c] for c in keep), T.StructField(text_col, T.StringType())]))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256, from the ids that encode() gives and decode() of them.

    Encoding, decoding and digests share one pass, so ids never travel through the JVM.
    """
    vocab = _vocabulary(docs, path)

    def run(batches):
        own = codec(vocab.value)
        names = [str(i) for i in range(len(own.size))]
        for batch in batches:
            for part in slices(batch, text_col):
                n, ids_sha, text_sha = [], [], []
                for ids in own.texts(part.column(text_col)):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)

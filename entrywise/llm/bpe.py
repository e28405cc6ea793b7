"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a piece of text there is exactly one token that can end its
BPE encoding. The candidates are the vocabulary entries that are suffixes of
the prefix, found for all prefixes at once by a suffix automaton over the
vocabulary; a candidate is right if it spans the whole prefix, or if it is
compatible with the last token of the rest, that is if no merge would ever join
the two across their border. Following the last tokens back from the end gives
the ids. Pieces repeat a lot, so their encodings are kept in a bounded table.

Defined results: a null text is an empty text and has no ids; special tokens of
the vocabulary file that occur in a text become their ids, as the tokenizers
library does; ill-formed sequences decode to U+FFFD. A vocabulary file with a
normalizer, another pre-tokenizer or stripping special tokens is refused.
`add_tokens` replaces a column with the name of its output.
"""

from __future__ import annotations

import hashlib
import json
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, unused

#: The pattern that cuts text into pieces before any merge.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_RUN = regex.compile(r"\s\s")
#: Entries of a worker's tables of pieces and pairs.
TABLE_SIZE = 300_000


class Recent:
    """A table of at most TABLE_SIZE entries that keeps what is used: when half of it is new, what wasn't asked for since the last time goes."""

    def __init__(self, size: int = TABLE_SIZE):
        self.half, self.new, self.old = size // 2, {}, {}

    def put(self, key, value) -> None:
        if len(self.new) >= self.half:
            self.new, self.old = {}, self.new
        self.new[key] = value

    def get(self, key):
        got = self.new.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got


def check_supported(spec: dict) -> None:
    """Refuse a vocabulary file that asks for more than byte-level BPE without changes to the text."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += ["normalizer"] if spec.get("normalizer") else []
    wrong += ["model"] if model.get("type", "BPE") != "BPE" else []
    wrong += ["pre_tokenizer"] if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) else []
    wrong += sorted({k for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)})
    if wrong:
        raise ValueError(f"not supported in a vocabulary file: {', '.join(wrong)}")


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_supported(spec)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in word)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for word, i in self.special.items():
            self.bytes_of[i] = word.encode()
        self.merge: dict[tuple[int, int], int] = {}
        #: What a token is made of and the rank of the merge that makes it.
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.merge[a, b] = rank
            self.parts.setdefault(whole, (a, b, rank))
        self.length = [len(b) for b in self.bytes_of]
        self.automaton = ahocorasick.Automaton()
        for i in vocab.values():
            self.automaton.add_word(self.bytes_of[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self._compatible = Recent(2 * TABLE_SIZE)
        self._pieces, self._chunks = Recent(), Recent()
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether `left` followed by `right` stays two tokens.

        Merges happen in rank order. Going back in time, the tokens at the
        border are the outer parts of `left` and `right`; a merge of such a
        pair happens if its rank comes before the merges that consume either.
        On equal ranks the leftmost pair goes first.
        """
        key = left << 20 | right
        never = 1 << 30
        a, b, a_ends, b_ends, fits = left, right, never, never, True
        while True:
            rank = self.merge.get((a, b))
            if rank is not None and rank < a_ends and rank <= b_ends:
                fits = False
                break
            pa_, pb_ = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb_ is None:
                break
            if pb_ is None or (pa_ is not None and pa_[2] >= pb_[2]):
                a, a_ends = pa_[1], pa_[2]
            else:
                b, b_ends = pb_[0], pb_[2]
        self._compatible.put(key, fits)
        return fits

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as one character per byte."""
        n = len(piece)
        last = [-1] * (n + 1)
        length, compatible, known = self.length, self.compatible, self._compatible.get
        for end, token in self.automaton.iter(piece):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - length[token]
            if begin:
                before = last[begin]
                fits = known(before << 20 | token)
                if fits is None:
                    fits = compatible(before, token)
                if not fits:
                    continue
            last[end] = token
        ids = []
        while n:
            ids.append(last[n])
            n -= length[last[n]]
        ids.reverse()
        return ids

    def _piece_bytes(self, piece: str) -> bytes:
        got = self._pieces.get(piece)
        if got is None:
            raw = piece.encode("utf-8", "surrogatepass").decode("latin-1")
            ids = self.encode_piece(raw)
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= 64:
                self._pieces.put(piece, got)
        return got

    def _plain(self, text: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of text without special tokens."""
        piece = self._piece_bytes
        if _RUN.search(text):
            return b"".join(map(piece, PIECES.findall(text)))
        # Without two white space characters in a row no piece reaches over a space, and what follows a space depends on nothing before it.
        chunks = self._chunks
        known = chunks.new.get
        out = []
        parts = text.split(" ")
        for k, part in enumerate(parts):
            chunk = " " + part if k else part
            got = known(chunk)
            if got is None:
                got = chunks.get(chunk)
                if got is None:
                    got = b"".join(map(piece, PIECES.findall(chunk)))
                    if len(chunk) <= 32:
                        chunks.put(chunk, got)
                known = chunks.new.get
            out.append(got)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._split is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._plain(p) for p in self._split.split(text) if p)

    def decode(self, ids: bytes) -> str:
        """The text of ids given as encode() gives them."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_column(text: Column, path: str) -> Column:
    """array<int> of ids."""

    @F.arrow_udf("array<int>")
    def encode(batch: pa.Array) -> pa.Array:
        c = codec(path)
        ids = [c.encode(t.as_py()) for t in batch]
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), pa.int32()))

    return encode(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of an array of ids; null for null."""

    @F.arrow_udf("string")
    def decode(batch: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([None if x is None else c.decode(np.array(x, dtype="<u4").tobytes()) for x in batch.to_pylist()], pa.string())

    return decode(ids)


def digest_column(text: Column, path: str) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256>: the text is encoded and its ids are decoded again."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batch: pa.Array) -> pa.Array:
        c = codec(path)
        n, first, second = [], [], []
        for t in batch:
            ids = c.encode(t.as_py())
            n.append(len(ids) // 4)
            first.append(hashlib.sha256(ids).hexdigest())
            second.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(text)


def add_tokens(df: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Append the ids of each text."""
    ship(df.sparkSession)
    return df.withColumn(out, encode_column(F.col(f"`{text}`"), path))


def token_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text for every row."""
    ship(df.sparkSession)
    held = unused(df, "_ids")
    return df.withColumn(held, digest_column(F.col(f"`{text}`"), path)).select(F.col(f"`{key}`").alias("doc_id"), F.col(held)["n_tokens"].alias("n_tokens"), F.col(held)["ids_sha256"].alias("ids_sha256"), F.col(held)["decoded_sha256"].alias("decoded_sha256"))

"""Token ids of whole texts by a public byte-level BPE, through cuts that no vocabulary token can span."""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewave.session import spread

#: Folder of the public vocabularies; a parameter everywhere.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

#: The tokenizer's public splitting pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Last bytes of the UTF-8 forms of the white space characters above ASCII.
LAST_OF_SPACES = (0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F)
ASCII_SPACES = (9, 10, 11, 12, 13, 32)

#: Fragments of more bytes are encoded anew each time; entries a task keeps of the shorter ones.
CACHED_BYTES, CACHED_FRAGMENTS = 40, 400_000
#: Bytes of text that are encoded together, a longer text alone.
PORTION = 8 << 20
#: Stretches between white space are cut further only from so many bytes on: shorter ones recur as whole words.
LONG_STRETCH = 96


def read_ranks(folder: str = TOKENIZERS, name: str = VOCABULARY) -> dict[bytes, int]:
    with open(f"{folder}/{name}", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def cut_table(ranks: dict[bytes, int]) -> np.ndarray:
    """256 x 256 booleans: whether a text may be cut between these two bytes without changing its ids.

    The pair must occur inside no token, so no merge crosses it. The splitting pattern must not see the cut either: the
    second byte starts a character and is no apostrophe (it could begin a contraction), and the first byte ends no white
    space (white space before a word gives its last character to the word). Before ASCII white space any such pair is safe.
    """
    inside = np.zeros((256, 256), bool)
    for token in ranks:
        b = np.frombuffer(token, np.uint8)
        inside[b[:-1], b[1:]] = True
    cut = ~inside
    cut[:, 0x80:0xC0] = False
    cut[:, ord("'")] = False
    spaces = np.isin(np.arange(256), [*LAST_OF_SPACES, *ASCII_SPACES])
    starts = np.isin(np.arange(256), ASCII_SPACES)
    cut[np.ix_(spaces, ~starts)] = False
    return cut


class FragmentEncoder:
    """Encodes batches of texts by fragments, remembering the ids of short ones."""

    def __init__(self, folder: str, name: str):
        import tiktoken

        ranks = read_ranks(folder, name)
        self.cut = cut_table(ranks).ravel()
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.space = np.isin(np.arange(256), ASCII_SPACES)
        self.known: dict[bytes, tuple[int, ...]] = {}

    def fragments(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Positions at which fragments of the joined UTF-8 bytes begin; every text's start is one."""
        if len(data) < 2:
            return np.unique(starts[starts < len(data)])
        pair = data[:-1].astype(np.uint16) << 8
        pair |= data[1:]
        safe = np.concatenate([[True], self.cut[pair]])
        safe[starts[starts < len(data)]] = True
        words = safe & self.space[data]
        words[0] = True
        words[starts[starts < len(data)]] = True
        at = np.flatnonzero(words)
        size = np.diff(at, append=len(data))
        if (size > LONG_STRETCH).any():
            return np.flatnonzero(words | (safe & np.repeat(size > LONG_STRETCH, size)))
        return at

    def batch(self, texts: pa.Array, count_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids or None, end offset of each text's ids). A null and an empty text have no ids."""
        texts = pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        if offsets[-1] == offsets[0]:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        raw = memoryview(texts.buffers()[2])[offsets[0] : offsets[-1]]
        data, ends = np.frombuffer(raw, np.uint8), offsets[1:] - offsets[0]
        cuts = self.fragments(data, (offsets[:-1] - offsets[0]))
        whole, known, encode, out = bytes(raw), self.known, self.encode, []
        at = cuts.tolist()
        for a, b in zip(at, [*at[1:], len(whole)]):
            f = whole[a:b]
            ids = known.get(f)
            if ids is None:
                ids = tuple(encode(f.decode("utf-8", "replace")))
                if b - a <= CACHED_BYTES and len(known) < CACHED_FRAGMENTS:
                    known[f] = ids
            out.append(ids)
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        total = np.concatenate([[0], np.cumsum(sizes)])
        upto = total[np.searchsorted(cuts, ends)]
        if count_only:
            return np.zeros(0, np.int32), upto
        return np.fromiter(itertools.chain.from_iterable(out), np.int32, int(total[-1])), upto


@lru_cache(2)
def encoder(folder: str, name: str) -> FragmentEncoder:
    return FragmentEncoder(folder, name)


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches (key, text) in slices of at most PORTION bytes of text, or of one text."""
    for b in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(1)), 0), np.int64)
        upto, at = np.concatenate([[0], np.cumsum(size)]), 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + PORTION, "right")) - 1)
            yield b.slice(at, end - at)
            at = end
        if not b.num_rows:
            yield b


def _names(df: DataFrame, key: str, text: str) -> DataFrame:
    return spread(df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")))


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of each whole text, no special tokens; strings of special tokens are ordinary text.

    One narrow pass, without a shuffle unless a small table has fewer splits than there are cores. A null and an empty text give an empty list; repeated rows give repeated rows; an
    empty table gives an empty one. A text of any length is encoded whole.
    """
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in portions(batches):
            ids, upto = enc.batch(b.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]).astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["__key", "ids"])

    return _names(df, key, text).mapInArrow(run, T.StructType([T.StructField("__key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])).withColumnRenamed("__key", key)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens): the number of token ids of each whole text; 0 for null and empty texts."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in portions(batches):
            _, upto = enc.batch(b.column(1), count_only=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(upto, prepend=0), pa.int64())], ["__key", "n_tokens"])

    return _names(df, key, text).mapInArrow(run, T.StructType([T.StructField("__key", kind), T.StructField("n_tokens", T.LongType())])).withColumnRenamed("__key", key)

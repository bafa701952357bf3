"""Nucleotide text to signal: k-mer numbers, strands and the expected reading of each k-mer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Length of the k-mers of either kind of molecule.
RNA, DNA = 5, 6
#: Columns of a k-mer model, by signal type: mean, deviation, deviation of the deviation, sum of both.
SIGNAL_TYPES = ("mean", "sd", "sd_sd", "sd_sum")


def clean_bases(seq: Column | str, rna: bool = False) -> Column:
    """Capitals A, C, G, T; U counts as T in RNA; every other character counts as A. Only ASCII letters have capitals here."""
    seq = F.translate(F.col(seq) if isinstance(seq, str) else seq, "acgtu", "ACGTU")
    return F.regexp_replace(F.translate(seq, "U", "T") if rna else seq, "[^ACGT]", "A")


def reverse_complement(seq: Column | str) -> Column:
    """Of cleaned bases."""
    return F.reverse(F.translate(F.col(seq) if isinstance(seq, str) else seq, "ACGT", "TGCA"))


def kmer_indexes(seq: Column | str, k: int) -> Column:
    """Numbers of the k-mers of cleaned bases in order, base 4 with A 0, C 1, G 2, T 3, the first base most significant.

    Sequences shorter than k give an empty list, null gives null. An Arrow function: one pass over each sequence, where a
    column expression would take a substring for every k-mer.
    """
    digit = np.zeros(256, np.int32)
    digit[np.frombuffer(b"ACGT", np.uint8)] = range(4)

    @F.pandas_udf("array<int>")
    def number(s: pd.Series) -> pd.Series:
        def one(x: str | None):
            if x is None:
                return None
            d = digit[np.frombuffer(x.encode(), np.uint8)]
            n = len(d) - k + 1
            if n <= 0:
                return np.zeros(0, np.int32)
            out = np.zeros(n, np.int32)
            for j in range(k):
                out = out * 4 + d[j : j + n]
            return out

        return s.map(one)

    return number(F.col(seq) if isinstance(seq, str) else seq)


def model_values(model: DataFrame, k: int, signal_type: int = 0) -> np.ndarray:
    """Expected readings by k-mer number, 4**k of them; missing rows are NaN, a k-mer with several raises ValueError."""
    out = np.full(4**k, np.nan)
    rows = model.where(F.col("kmer_idx").between(0, 4**k - 1)).groupBy("kmer_idx").agg(F.first(F.col(SIGNAL_TYPES[signal_type]).cast("double")).alias("v"), F.count("*").alias("n"))
    for r in rows.collect():  # a row a k-mer
        if r["n"] > 1:
            raise ValueError(f"k-mer {r['kmer_idx']} has {r['n']} rows in the model")
        out[r["kmer_idx"]] = r["v"] if r["v"] is not None else np.nan
    return out


#: Characters of text that are encoded at a time, or one whole text: 2 MB of values a strand.
PORTION = 1 << 18


def encoded(texts: pa.Array, table: np.ndarray, k: int, rna: bool, forward: bool, complement: bool) -> Iterator[tuple[int, int, pa.ListArray]]:
    """(from, to, signals) of portions of the texts, in order: as `encode` gives them, `table` holding the reading of each k-mer.

    Bytes that continue a character are left out, so that each character is one base, as in `clean_bases`.
    """
    digit = np.zeros(256, np.int32)
    digit[np.frombuffer(b"ACGTacgt" + b"Uu" * rna, np.uint8)] = [0, 1, 2, 3] * 2 + [3, 3] * rna
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    upto, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + PORTION, "right")) - 1)
        raw = np.frombuffer("".join(x for x in texts.slice(at, end - at).to_pylist() if x is not None).encode(), np.uint8)
        first = (raw & 0xC0) != 0x80
        edge = np.concatenate([[0], np.cumsum(first)])[upto[at : end + 1] - upto[at]]
        d = digit[raw[first]]
        windows = max(0, len(d) - k + 1)
        strands = []
        if forward:
            number = np.zeros(windows, np.int32)
            for j in range(k):
                number = number * 4 + d[j : j + windows]
            strands.append((table[number], 1))
        if complement:
            number = np.zeros(windows, np.int32)
            for j in reversed(range(k)):
                number = number * 4 + (3 - d[j : j + windows])
            strands.append((table[number], -1))
        counts = np.maximum(np.diff(edge) - k + 1, 0)
        ends = np.concatenate([[0], np.cumsum(counts * len(strands))])
        out = np.empty(ends[-1])
        for a, n, to in zip(edge.tolist(), counts.tolist(), ends.tolist()):
            for i, (values, step) in enumerate(strands if n else ()):
                out[to + i * n : to + (i + 1) * n] = values[a : a + n][::step]
        missing = pa.array(np.asarray(texts.slice(at, end - at).is_null())) if strands and texts.null_count else None
        yield at, end, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out), mask=missing)
        at = end


def encode(seqs: DataFrame, model: DataFrame, rna: bool = False, signal_type: int = 0, forward: bool = True, complement: bool = False, seq: str = "sequence") -> DataFrame:
    """`seqs` with `values`: the signal of the sequence, of its reverse complement, or of both joined in that order.

    A sequence of n bases gives n - k + 1 values a strand, none if n < k; null gives null. Bases are cleaned as by `clean_bases`. The signals of
    a portion of the sequences leave a task before those of the next are made, as they take many times the room of the text.
    """
    k = RNA if rna else DNA
    table = model_values(model, k, signal_type)
    columns = [c for c in seqs.columns if c != "values"]
    rows = seqs.select(*[F.col(f"`{c}`") for c in columns], F.col(seq).alias("__seq"))
    schema = StructType([*(seqs.schema[c] for c in columns), StructField("values", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end, signals in encoded(b.column(len(columns)), table, k, rna, forward, complement):
                yield pa.RecordBatch.from_arrays([*(c.slice(at, end - at) for c in b.columns[:-1]), signals], [*columns, "values"])

    return rows.mapInArrow(run, schema)

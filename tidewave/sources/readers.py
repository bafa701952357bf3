"""Readers of series, sequences and intervals; each gives one row per sequence, or per interval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File endings that the directory listing accepts.
ENDINGS = (".fast5", ".txt", ".fna", ".bin", ".tsv")


def list_files(spark: SparkSession, folder: str, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """(path, length) of the folder's own files with an accepted ending, in order of path; none gives no rows."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*{" + ",".join(endings) + "}").option("recursiveFileLookup", "false").load(folder)
    return found.select("path", "length").orderBy("path")


def file_lengths(spark: SparkSession, path: str | list[str]) -> list[int]:
    """Bytes of each file that a path, pattern or folder names, empty ones too, which scans pass over."""
    out = []
    for p in [path] if isinstance(path, str) else path:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in fs.globStatus(at) or []:
            out += [f.getLen() for f in (fs.listStatus(found.getPath()) if found.isDirectory() else [found]) if f.isFile()]
    return out


def file_name(path) -> F.Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def read_text_series(spark: SparkSession, path: str | list[str], keep_unterminated: bool = True) -> DataFrame:
    """(name, values) of each text file: the first white-space token of each line, as a number.

    Lines stay in file order. Lines without a token are left out; a token that is no number is a null value. With
    keep_unterminated false, a last line without a newline is dropped.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    text = F.col("text") if keep_unterminated else F.regexp_replace("text", r"[^\n]*\z", "")
    tokens = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_extract(x, r"(\S+)", 1)), lambda x: x != "")
    return whole.select(file_name(F.col("path")).alias("name"), F.transform(tokens, lambda x: x.try_cast("double")).alias("values"))


def read_tsv_series(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, values) of each line `name TAB value TAB ...`; blank lines are left out, a field that is no number is null."""
    parts = F.split(F.regexp_replace("value", r"\r$", ""), "\t")
    return spark.read.text(path).where(F.trim("value") != "").select(F.element_at(parts, 1).alias("name"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("double")).alias("values"))


def read_binary_series(spark: SparkSession, path: str | list[str], dtype: str = "<f4") -> DataFrame:
    """(name, values) of each binary file, its bytes taken as numbers of `dtype`; bytes beyond the last whole number are left.

    An empty file gives an empty list.
    """
    size = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.frombuffer(x.as_py(), np.uint8)[: len(x.as_py()) // size * size].view(dtype).astype(np.float64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.float64()))], ["name", "values"])

    files = spark.read.format("binaryFile").load(path).select(file_name(F.col("path")).alias("name"), "content")
    return files.mapInArrow(run, "name string, values array<double>")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, sequence) of each record of FASTA files: names keep their '>', lines are joined and put in capitals.

    Blank lines are skipped; a header without letters gives an empty sequence; text before the first header is left out.
    Files are split at headers, so a large one is read by many tasks.
    """
    records = spark.read.text(path, lineSep="\n>").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            names, seqs = [], []
            for text, *at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if at != before and not at[1]:  # the start of a file: what has no '>' isn't a record
                    text = text[1:] if text.startswith(">") else None
                before = at
                if text is not None:
                    head, _, body = text.partition("\n")
                    names.append(">" + head.rstrip("\r"))
                    seqs.append("".join(body.split()).upper())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(seqs, pa.string())], ["name", "sequence"])

    return records.mapInArrow(run, "name string, sequence string")


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, start, stop) of BED files, half-open ends made inclusive.

    Carriage returns are stripped, fields after the third ignored. A line of fewer than three fields or with ends that are no
    numbers fails the whole load with ValueError, as does an empty file: the lines are checked before anything is given out.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r", "").alias("line"))
    parts = F.split("line", "\t")
    name, start, end = F.get(parts, 0), F.get(parts, 1).try_cast("bigint"), F.get(parts, 2).try_cast("bigint")
    bad = lines.where(start.isNull() | end.isNull()).first()
    if bad is not None:
        raise ValueError(f"malformed interval line: {bad['line']}")
    if lines.isEmpty() or any(not n for n in file_lengths(spark, path)):
        raise ValueError(f"an interval file without lines: {path}")
    return lines.select(name.alias("name"), start.alias("start"), (end - 1).alias("stop"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, name, start, end, single_strand) of an offset index: a flag line, then `name TAB cumulative end` lines in order."""
    whole = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n").alias("lines"))
    flag = F.element_at("lines", 1).cast("int")
    rows = whole.select(flag.alias("single_strand"), F.posexplode(F.expr("slice(lines, 2, greatest(size(lines) - 1, 0))")).alias("seq_id", "line")).where("line like '%\t%'")
    parts = F.split("line", "\t")
    end = F.element_at(parts, 2).cast("bigint")
    rows = rows.select(F.col("seq_id").cast("bigint").alias("seq_id"), F.element_at(parts, 1).alias("name"), end.alias("end"), "single_strand")
    return rows.withColumn("start", F.coalesce(F.lag("end").over(Window.partitionBy("single_strand").orderBy("seq_id")), F.lit(0))).select("seq_id", "name", "start", "end", "single_strand")


def read_series(spark: SparkSession, path: str, encode=None) -> DataFrame:
    """(name, values) of files told by their ending: text, TSV, binary, FASTA (through `encode`) or FAST5.

    A path without one of these endings is a folder, whose own files are read each by its kind; others in it are left out, and a
    folder without any raises ValueError. `encode` maps a DataFrame (name, sequence) to (name, values).
    """
    ending = next((e for e in ENDINGS if path.rstrip("}*").endswith(e)), None)
    if ending is None and "." in path.rstrip("/").rsplit("/", 1)[-1].lstrip("."):
        raise ValueError(f"no reader for {path}")
    if ending is None:
        found = list_files(spark, path).select(F.regexp_extract("path", r"(\.[^.]+)$", 1).alias("e")).distinct().collect()  # five at most
        kinds = [read_series(spark, f"{path.rstrip('/')}/*{r['e']}", encode) for r in sorted(found)]
        if not kinds:
            raise ValueError(f"no file to read in {path}")
        out = kinds[0]
        for k in kinds[1:]:
            out = out.unionByName(k)
        return out
    if ending == ".txt":
        return read_text_series(spark, path)
    if ending == ".tsv":
        return read_tsv_series(spark, path)
    if ending == ".bin":
        return read_binary_series(spark, path)
    if ending == ".fna":
        if encode is None:
            raise ValueError("FASTA needs an encoder to become a series")
        return encode(read_fasta(spark, path)).select("name", "values")
    from tidewave.sources.fast5 import register

    return spark.read.format(register(spark)).load(path)


def load_subject(spark: SparkSession, path: str, encode=None, std: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(series, statistics) of the subject at `path`: (name, values) and their mean, sd, low and high over all values.

    `std`, the path of parallel deviations by the same names, adds the column `std`; where the two aren't equally long, or one is
    missing, or there is no value at all, ValueError.
    """
    from tidewave.operators.normalize import list_stats

    series = read_series(spark, path, encode)
    if std is not None:
        other = read_series(spark, std, encode).select(F.col("name").alias("__n"), F.col("values").alias("std"))
        both = series.join(other, F.col("name") == F.col("__n"), "full")
        if not both.where("name is null or __n is null or size(values) <> size(std)").isEmpty():
            raise ValueError("values and deviations of a subject must be the same series, equally long")
        series = both.drop("__n")
    stats = list_stats(series, [], "values")
    if not stats.first()["n"]:
        raise ValueError(f"a subject without values: {path}")
    return series, stats


def count_records(spark: SparkSession, path: str) -> int:
    """Sequences in a FASTA (headers) or TSV (lines) file, or reads in FAST5 files, without building them."""
    ending = path[path.rfind(".") :].rstrip("}*/")
    if ending == ".fast5":
        from tidewave.sources.fast5 import register

        return spark.read.format(register(spark)).option("names", "true").load(path).select("name").count()
    if ending not in (".fna", ".tsv"):
        raise ValueError(f"no count of records for {path}")
    return spark.read.text(path).where(F.col("value").startswith(">") if ending == ".fna" else F.trim("value") != "").count()


def decode_samples(raw: str | F.Column, dtype: str = "<i2") -> F.Column:
    """Column of samples from a column of raw bytes; null bytes give null."""

    @F.pandas_udf("array<double>")
    def decode(s):
        size = np.dtype(dtype).itemsize
        return s.map(lambda x: None if x is None else np.frombuffer(bytes(x), np.uint8)[: len(x) // size * size].view(dtype).astype(np.float64))

    return decode(raw)

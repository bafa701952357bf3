"""FAST5 (HDF5) files as a Spark data source; it needs h5py, which is imported only when files are read."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def h5py():
    try:
        import h5py as module
    except ImportError as e:
        raise ImportError("reading FAST5 files needs the package h5py") from e
    return module


class ReadsPartition(InputPartition):
    def __init__(self, path: str, channel: str | None = None, start: int = 0, end: int | None = None, first: bool = True):
        self.path, self.channel, self.start, self.end, self.first = path, channel, start, end, first


class Fast5Reader(DataSourceReader):
    """One partition per file; given `channels` one per file and channel, for bulk files, which hold whole channels.

    Options: path (file, folder or pattern), channels (FIRST-LAST), start and end (samples of a bulk channel), names (true: null values,
    no samples are read). Files are opened by the tasks only. Reads without a name, samples or access are skipped.
    """

    def __init__(self, options: dict):
        self.path, self.start, self.end = Path(options["path"].removeprefix("file:")), int(options.get("start", 0)), options.get("end")
        self.channels = [int(x) for x in options["channels"].split("-")] if "channels" in options else None
        self.names = options.get("names", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        files = sorted(self.path.glob("*.fast5")) if self.path.is_dir() else sorted(self.path.parent.glob(self.path.name))
        numbers = [f"Channel_{n}" for n in range(self.channels[0], self.channels[-1] + 1)] if self.channels else [None]
        return [ReadsPartition(str(f), c, self.start, None if self.end is None else int(self.end), c == numbers[0]) for f in files for c in numbers]

    def read(self, partition: ReadsPartition) -> Iterator[tuple]:
        with h5py().File(partition.path, "r") as h:
            yield from reads(h, partition, self.names)


def reads(h, p: ReadsPartition, names: bool = False) -> Iterator[tuple]:
    """The reads of an open file: of a bulk file those of the partition's channel, or of every channel, else all of them."""
    if not is_bulk(h):
        if p.channel is None or p.first:  # a file of reads is read once, not once a channel
            yield from single_and_multi_reads(h, names)
        return
    for channel in [p.channel] if p.channel else h["Raw"]:
        if channel in h["Raw"]:
            yield from bulk_reads(h, ReadsPartition(p.path, channel, p.start, p.end), names)


def is_bulk(h) -> bool:
    """Whether the file holds whole channels rather than reads."""
    return "Raw" in h and "Channel_1" in h["Raw"]


def single_and_multi_reads(h, names: bool = False) -> Iterator[tuple]:
    groups = [(n, g) for n, g in h["Raw/Reads"].items()] if "Raw" in h and "Reads" in h["Raw"] else [(n, g["Raw"]) for n, g in h.items() if n.lower().startswith("read_") and "Raw" in g]
    for name, g in groups:
        if name and "Signal" in g and len(g["Signal"]):
            yield name, None if names else [float(x) for x in g["Signal"][:]]


def bulk_reads(h, p: ReadsPartition, names: bool = False) -> Iterator[tuple]:
    signal = h["Raw"][p.channel]["Signal"]
    end = len(signal) if p.end is None else min(p.end, len(signal))
    if end > p.start:
        yield f"{p.channel}_{p.start}_{end}", None if names else [float(x) for x in signal[p.start : end]]


class Fast5Source(DataSource):
    """`spark.read.format("fast5")`: (name, values) of each read."""

    @classmethod
    def name(cls) -> str:
        return "fast5"

    def schema(self) -> str:
        return "name string, values array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return Fast5Reader(self.options)


def register(spark: SparkSession) -> str:
    spark.dataSource.register(Fast5Source)
    return Fast5Source.name()

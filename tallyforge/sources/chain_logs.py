"""Chain logs as a Python data source, for batch and streaming.

A folder has files ``<first block>-<last block>.jsonl`` with a log on each line.
A batch read plans a partition for each file that meets the block range; a stream
takes up to ``blocks_per_batch`` blocks at a time, and its offset is the next
block, so a restart goes on where the checkpoint says.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "chain_id int, tx_hash string, block_number long, log_index int, token string, topics array<string>, data string"
_FIELDS = ("chain_id", "tx_hash", "block_number", "log_index", "token", "topics", "data")
BLOCKS = 2000


@dataclass
class Blocks(InputPartition):
    path: str
    first: int
    last: int

    def __post_init__(self) -> None:
        super().__init__(self.path)


def _files(path: str) -> list[tuple[str, int, int]]:
    fs, root = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    out = []
    for info in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)):
        if m := re.fullmatch(r"(\d+)-(\d+)\.jsonl", info.base_name):
            out.append((info.path, int(m[1]), int(m[2])))
    return sorted(out, key=lambda f: f[1])


def _plan(path: str, first: int, last: int) -> list[Blocks]:
    return [Blocks(name, max(first, a), min(last, b)) for name, a, b in _files(path) if a <= last and b >= first]


def _rows(path: str, part: Blocks) -> Iterator[tuple]:
    fs = pyarrow.fs.FileSystem.from_uri(path)[0] if "://" in path else pyarrow.fs.LocalFileSystem()
    with fs.open_input_stream(part.path) as f:
        for line in f.read().decode().splitlines():
            row = json.loads(line)
            if part.first <= row["block_number"] <= part.last:
                yield tuple(row.get(c) for c in _FIELDS)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.first, self.last = options["path"], int(options.get("first_block", 0)), int(options.get("last_block", 1 << 62))

    def partitions(self) -> list[Blocks]:
        return _plan(self.path, self.first, self.last)

    def read(self, partition: Blocks) -> Iterator[tuple]:
        return _rows(self.path, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.start, self.step = options["path"], int(options.get("first_block", 0)), int(options.get("blocks_per_batch", BLOCKS))
        self.at: int | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"block": self.start}

    def latestOffset(self, *_: object) -> dict:  # noqa: N802
        newest = max((b + 1 for _, _, b in _files(self.path)), default=self.start)
        self.at = newest if self.at is None else max(self.at, newest)
        return {"block": self.at}

    def partitions(self, start: dict, end: dict) -> list[Blocks]:
        return [p for first in range(start["block"], end["block"], self.step) for p in _plan(self.path, first, min(first + self.step, end["block"]) - 1)]

    def read(self, partition: Blocks) -> Iterator[tuple]:
        return _rows(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class ChainLogs(DataSource):
    """``spark.read.format("chain_logs")`` and ``spark.readStream.format("chain_logs")``."""

    @classmethod
    def name(cls) -> str:
        return "chain_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> _StreamReader:  # noqa: N802
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChainLogs)

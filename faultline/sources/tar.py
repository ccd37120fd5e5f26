"""Tar shards of samples as a data source of Spark.

A folder's indexes stand beside it, in ``<folder>.index``: key, name, place and size of each member of a shard, made at
writing or by ``index_shards``. Reading:
rows are (shard, key, name, size, data). A shard with an index is read in splits of ``splitsize`` bytes, each of whole
samples; small shards share a task up to that size, and beyond ``MOST_PARTITIONS`` neighbouring splits do; with option ``keys`` (joined by commas) only the members of those keys are fetched; with option ``headers`` data is
null and nothing but the index is read. A shard without one is streamed as one partition, or for headers read by seeking
from header to header. Writing: rows (key, media
array<binary>, json string); each task writes its own shards under passing names, and a shard is closed at ``maxcount``
samples or ``maxsize`` bytes. Shards get their names, ``subtaskdata-%d.tar``, when the whole job commits: a task that
runs again, or a job that fails, leaves no shard. Appending numbers on; overwriting removes the shards that were there.
"""

from __future__ import annotations

import io
import json
import os
import re
import tarfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from faultline.sources.files import listed, put, store_of


#: Tasks of a scan at most, and what opening a shard costs, as bytes; a task reads its splits one after another.
MOST_PARTITIONS, OPEN_COST = 1000, 4 << 20
#: Shards that the driver names at once when a job commits.
MOVERS = 16


class TarSamples(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tar_samples"

    def schema(self) -> str:
        return "shard string, key string, name string, size long, data binary"

    def reader(self, schema) -> "TarReader":
        return TarReader(self.options)

    def writer(self, schema, overwrite: bool) -> "TarWriter":
        return TarWriter(self.options, overwrite)


def beside(folder: str) -> str:
    """The folder of the indexes of a folder's shards, which go by the names of the shards."""
    return folder.rstrip("/") + ".index"


def members(tar: tarfile.TarFile) -> Iterator[tuple[str, str, int, int]]:
    """key, name, place and size of each member."""
    for member in tar:
        key, _, name = os.path.basename(member.name).partition(".")
        yield key, name, member.offset_data, member.size


def index_text(shard_size: int, rows: list[tuple[str, str, int, int]]) -> bytes:
    return "\n".join([json.dumps(shard_size), *map(json.dumps, rows)]).encode()


def read_index(store: fs.FileSystem, path: str, name: str) -> list[list] | None:
    """The index of a shard; none if there is none, or if it was made of a file of another size."""
    size, index = store.get_file_info([f"{path}/{name}", f"{beside(path)}/{name}"])
    if not index.is_file:
        return None
    with store.open_input_stream(index.path) as source:
        head, *rows = source.read().decode().split("\n")
    return [json.loads(r) for r in rows] if json.loads(head) == size.size else None


@dataclass
class Split:
    name: str
    low: int
    high: int


@dataclass
class Splits(InputPartition):
    splits: list[Split]


def packed(splits: list[Split], sizes: list[int], most: int) -> list[Splits]:
    """Neighbouring splits together, up to ``most`` bytes, or more where there would be more than MOST_PARTITIONS; those of one shard become one."""
    costs = [n + OPEN_COST for n in sizes]
    most = max(most, -(-sum(costs) // MOST_PARTITIONS))
    out: list[Splits] = []
    held = 0
    for split, cost in zip(splits, costs, strict=True):
        if not out or held + cost > most:
            out.append(Splits([]))
            held = 0
        mine = out[-1].splits
        if mine and mine[-1].name == split.name:
            mine[-1] = Split(split.name, mine[-1].low, split.high)
        else:
            mine.append(split)
        held += cost
    return out


class TarReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.most, self.split = options["path"], int(options.get("samples", 0)), int(options.get("splitsize", 128 << 20))
        self.keys = set(filter(None, options.get("keys", "").split(",")))
        self.headers = str(options.get("headers", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        store, path = store_of(self.folder)
        names, indexed = listed(self.folder, ".tar"), set(listed(beside(self.folder), ".tar"))
        sizes = [x.size for x in store.get_file_info([f"{path}/{n}" for n in names])] if names else []
        out, bytes_ = [], []
        for name, size in zip(names, sizes, strict=True):
            step = self.split if name in indexed and not (self.keys or self.most or self.headers) else size + 1
            out += [Split(name, low, low + step) for low in range(0, size + 1, step)]
            bytes_ += [0 if self.keys or self.headers else min(step, size - low) for low in range(0, size + 1, step)]
        return packed(out, bytes_, self.split)

    def read(self, partition: Splits) -> Iterator[tuple]:
        store, path = store_of(self.folder)
        for split in partition.splits:
            yield from self.of_split(store, path, split)

    def of_split(self, store: fs.FileSystem, path: str, partition: Split) -> Iterator[tuple]:
        shard = f"{path}/{partition.name}"
        index = read_index(store, path, partition.name)
        if index is None and partition.low:  # the index has gone: the first split reads all
            return
        if index is None and self.headers:
            with store.open_input_file(shard) as source, tarfile.open(fileobj=source, mode="r:") as tar:
                index = list(members(tar))
        if index is None:
            yield from self.chosen(partition.name, self.streamed(store, shard))
            return
        begins: dict[str, int] = {}
        for key, _, at, _ in index:
            begins.setdefault(key, at)
        mine = [x for x in index if partition.low <= begins[x[0]] < partition.high]  # a sample lies where it begins
        with store.open_input_file(shard) as source:

            def fetched() -> Iterator[tuple]:
                for key, name, at, size in mine:
                    if self.headers or (self.keys and key not in self.keys):
                        yield key, name, size, lambda: None
                    else:
                        yield key, name, size, lambda at=at, size=size: source.read_at(size, at)

            yield from self.chosen(partition.name, fetched())

    def streamed(self, store: fs.FileSystem, shard: str) -> Iterator[tuple]:
        with store.open_input_stream(shard) as source, tarfile.open(fileobj=source, mode="r|") as tar:
            for member in tar:
                key, _, name = os.path.basename(member.name).partition(".")
                yield key, name, member.size, lambda member=member: tar.extractfile(member).read()

    def chosen(self, shard: str, rows: Iterator[tuple]) -> Iterator[tuple]:
        """Rows of the keys asked for, of the first samples if so many are asked for; data is read for these only."""
        keys: list[str] = []
        for key, name, size, data in rows:
            if self.keys and key not in self.keys:
                continue
            if key not in keys[-1:]:
                keys.append(key)
                if self.most and len(keys) > self.most:
                    return
            yield shard, key, name, size, None if self.headers else data()


@dataclass
class Shards(WriterCommitMessage):
    task: int
    names: list[str]


class TarWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder, self.most, self.size = options["path"], int(options.get("maxcount", 128)), float(options.get("maxsize", 3e9))
        self.overwrite, self.passing = overwrite, f"_passing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Shards:
        store, path = store_of(self.folder)
        for at in (path, beside(path)):
            store.create_dir(f"{at}/{self.passing}", recursive=True)
        out, tar, names, count, size, index = None, None, [], 0, 0, []

        def close() -> None:
            tar.close()
            whole = out.tell()
            out.close()
            with store.open_output_stream(f"{beside(path)}/{names[-1]}") as side:
                side.write(index_text(whole, index))
            index.clear()

        def add(name: str, data: bytes) -> None:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
            key, _, rest = name.partition(".")
            index.append((key, rest, tar.offset - -(-len(data) // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE, len(data)))

        for row in rows:
            media = [bytes(m) for m in row.media or []]
            text = row.json.encode()
            own = sum(map(len, media)) + len(text)
            if tar and (count >= self.most or size + own > self.size):
                close()
                tar = None
            if not tar:
                names.append(f"{self.passing}/{uuid.uuid4().hex}")
                out = store.open_output_stream(f"{path}/{names[-1]}")
                tar, count, size = tarfile.open(fileobj=out, mode="w|"), 0, 0
            for k, data in enumerate(media):
                add(f"{row.key}.{k}_image", data)
            add(f"{row.key}.json", text)
            count, size = count + 1, size + own
        if tar:
            close()
        return Shards(TaskContext.get().partitionId(), names)

    def commit(self, messages: list[Shards | None]) -> None:
        store, path = store_of(self.folder)
        there = [x for x in listed(self.folder, ".tar") if re.fullmatch(r"subtaskdata-\d+\.tar", x)]
        if self.overwrite:
            for x in there:
                store.delete_file(f"{path}/{x}")
            for x in listed(beside(self.folder), ".tar"):
                store.delete_file(f"{beside(path)}/{x}")
            there = []
        number = max([int(re.findall(r"\d+", x)[0]) for x in there], default=-1) + 1
        names = [name for message in sorted((m for m in messages if m), key=lambda m: m.task) for name in message.names]

        def named(place: int) -> None:
            for at in (beside(path), path):
                store.move(f"{at}/{names[place]}", f"{at}/subtaskdata-{number + place}.tar")

        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(named, range(len(names))))
        self.abort(messages)

    def abort(self, messages: list[Shards | None]) -> None:
        store, path = store_of(self.folder)
        for at in (path, beside(path)):
            store.create_dir(f"{at}/{self.passing}", recursive=True)  # a job without rows made none
            store.delete_dir(f"{at}/{self.passing}")


def index_shards(spark, folder: str) -> int:
    """Indexes the shards of a folder that have no index, or that of another file; the number of them. Tasks read headers only."""
    names = listed(folder, ".tar")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = store_of(folder)
        store.create_dir(beside(path), recursive=True)
        for frame in frames:
            made = 0
            for name in frame["name"]:
                if read_index(store, path, name) is None:
                    with store.open_input_file(f"{path}/{name}") as source, tarfile.open(fileobj=source, mode="r:") as tar:
                        text = index_text(source.size(), list(members(tar)))
                    put(store, f"{beside(path)}/{name}", text)
                    made += 1
            yield pd.DataFrame({"n": [made]})

    if not names:
        return 0
    rows = spark.createDataFrame([(n,) for n in names], "name string").repartition(min(len(names), 1000))
    return rows.mapInPandas(work, "n long").groupBy().sum("n").first()[0] or 0


def register(spark) -> None:
    spark.dataSource.register(TarSamples)

"""Files with names of their own, in any store that pyarrow opens by its address (a mounted folder, HDFS, S3, GCS)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame

from faultline.sources.shared import spread


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder, and the folder's path in it."""
    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:") :]
    return fs.FileSystem.from_uri(folder)


def put(store: fs.FileSystem, path: str, data: bytes) -> None:
    """Writes a file under another name first, so that a name stands for a whole file; a second writer puts the same."""
    part = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def write_files(rows: DataFrame, folder: str) -> int:
    """One file for each row (name, data binary), by tasks whose number follows the rows; the number of rows."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = store_of(folder)
        there: set[str] = set()
        for f in frames:
            for name, data in zip(f["name"], f["data"], strict=True):
                target = f"{path}/{name}"
                if (within := target.rpartition("/")[0]) not in there:
                    store.create_dir(within, recursive=True)
                    if len(there) < 1000:
                        there.add(within)
                put(store, target, bytes(data))
            yield pd.DataFrame({"n": [len(f)]})

    return spread(rows.select("name", "data"), "name").mapInPandas(write, "n long").groupBy().sum("n").first()[0] or 0


def listed(folder: str, ending: str) -> list[str]:
    """Names of the files in a folder, sorted; empty if there is none."""
    store, path = store_of(folder)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(x.base_name for x in found if x.is_file and x.base_name.endswith(ending) and not x.base_name.startswith("."))

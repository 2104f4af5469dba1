"""Writing results: append-only logs, versioned tables, CSV export."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from urllib.parse import quote

from pyarrow import fs as file_system
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from credence.session import spread


def append_log(rows: DataFrame, path: str, on: str = "created_at", unit: str = "day") -> None:
    """Append-only table partitioned by day, or by the first day of a coarser unit where
    a batch spans years. A batch adds a file per unit and shuffle partition at most."""
    day = F.to_date(on) if unit == "day" else F.to_date(F.date_trunc(unit, on))
    rows.withColumn("day", day).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def write_version(rows: DataFrame, root: str) -> str:
    """A new version folder of a table; the reader switches by path, so a failed
    write never harms the version in use."""
    path = f"{root}/version={uuid.uuid4().hex}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, quoted where needed."""
    rows.write.mode("errorifexists").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def write_files(rows: DataFrame, path: str) -> None:
    """One file per (folder, name) of rows (folder, name, body), each body ended by a
    line feed: ``path/folder=.../name=...``, both quoted as in a URL. Rows of one name
    should be one. A folder holds its files itself, so that a scan lists as many folders
    as there are classes. A file appears under its name when it is whole; a task that is
    run again writes the same files."""
    store, root = file_system.FileSystem.from_uri(path) if "://" in path else (file_system.LocalFileSystem(), path)
    if store.get_file_info(root).type != file_system.FileType.NotFound:
        raise FileExistsError(path)
    store.create_dir(root)
    files = rows.select(*[F.col(c).cast("string").alias(c) for c in ("folder", "name", "body")])
    spread(files, "folder", "name").foreachPartition(lambda part: _write_part(path, part))


def _write_part(path: str, rows: Iterable[Row]) -> None:
    store, root = file_system.FileSystem.from_uri(path) if "://" in path else (file_system.LocalFileSystem(), path)
    made = set()
    for folder, name, body in rows:
        at = f"{root}/folder={_quoted(folder)}"
        if at not in made:
            store.create_dir(at)
            made.add(at)
        begun = f"{at}/_{uuid.uuid4().hex}"
        with store.open_output_stream(begun) as out:
            out.write(f"{body or ''}\n".encode())
        store.move(begun, f"{at}/name={_quoted(name)}")


def _quoted(value: str | None) -> str:
    return "__HIVE_DEFAULT_PARTITION__" if value is None else quote(value, safe="")

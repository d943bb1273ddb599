"""Folders of files that tasks read and write by themselves, on any file system that pyarrow knows."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, InputPartition, WriterCommitMessage

#: no more tasks than this read a folder
MOST_TASKS = 10_000
#: bytes of one file that a task reads before another takes a share of it
SHARE = 64 << 20


@dataclass
class Files(InputPartition):
    """Share ``nth`` of ``of`` of each of some files."""

    names: list[str]
    nth: int = 0
    of: int = 1


@dataclass
class Written(WriterCommitMessage):
    """(name that was written, name to have) of a task's files."""

    files: list[tuple[str, str]]


def opened(path: str):
    """(file system, path on it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def listed(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder, or of the one file that path names, in order."""
    from pyarrow import fs

    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(at))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(ending) and not f.base_name.startswith((".", "_")))


def shares(files: list[tuple[str, int]], split: bool) -> list[Files]:
    """A task for each file, for each share of a large one, or for several where there are very many."""
    whole = [name for name, size in files if not split or size <= SHARE]
    many = -(-len(whole) // MOST_TASKS) or 1
    out = [Files(whole[i : i + many]) for i in range(0, len(whole), many)]
    for name, size in files:
        if split and size > SHARE:
            n = -(-size // SHARE)
            out += [Files([name], i, n) for i in range(n)]
    return out


def put(path: str, content: bytes) -> str:
    """Writes a file under a name that readers pass over; the name is returned, and commit() gives the real one."""
    system, at = opened(path)
    system.create_dir(at, recursive=True)
    name = f".{uuid.uuid4().hex}"
    with system.open_output_stream(f"{at}/{name}") as out:
        out.write(content)
    return name


def commit(path: str, messages: list[Written | None], ending: str, overwrite: bool, notes: dict[str, bytes] | None = None) -> None:
    """Files of the tasks that ended well get their names; what was there before goes if it is to be overwritten."""
    system, at = opened(path)
    system.create_dir(at, recursive=True)
    files = [f for m in messages if m is not None for f in m.files]
    if overwrite:
        for old, _ in listed(path, ending):
            system.delete_file(old)
    for written, name in files:
        system.move(f"{at}/{written}", f"{at}/{name}")
    for name, content in (notes or {}).items():
        with system.open_output_stream(f"{at}/{name}") as out:
            out.write(content)


def abort(path: str, messages: list[Written | None]) -> None:
    system, at = opened(path)
    for written, _ in [f for m in messages if m is not None for f in m.files]:
        system.delete_file(f"{at}/{written}")


def box_of(text: str | None) -> tuple[float, float, float, float] | None:
    """west,south,east,north of an option; None if it is not set."""
    if not text:
        return None
    west, south, east, north = map(float, text.split(","))
    return west, south, east, north


def meets(a: tuple[float, float, float, float], b: tuple[float, float, float, float] | None) -> bool:
    return b is None or (a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1])


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.ending, self.overwrite = options["path"], options["ending"], overwrite

    def write(self, iterator):
        return Written([(put(self.path, bytes(row.content)), row.name + self.ending) for row in iterator])

    def commit(self, messages):
        commit(self.path, messages, self.ending, self.overwrite)

    def abort(self, messages):
        abort(self.path, messages)


class FileSink(DataSource):
    @classmethod
    def name(cls):
        return "viatrix_files"

    def writer(self, schema, overwrite):
        return FileWriter(dict(self.options), overwrite)


def write_files(df: DataFrame, path: str, ending: str) -> None:
    """Rows (name, content) as a file each, which replace the folder's files of that ending; names must be unique."""
    df.sparkSession.dataSource.register(FileSink)
    df.select("name", "content").write.format("viatrix_files").options(path=path, ending=ending).mode("overwrite").save()

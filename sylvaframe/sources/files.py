"""Files by path or URI: local ones, and whatever pyarrow's file systems reach (hdfs, s3, gs)."""

from __future__ import annotations

import io

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    """The file itself, or the files of the folder in order; hidden ones left out."""
    system, own = _at(path)
    head = path[: len(path) - len(own)] if path.endswith(own) else ""
    if system.get_file_info(own).type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(own))
        return [head + i.path for i in sorted(found, key=lambda i: i.path) if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))]
    return [path]


def open_read(path: str) -> io.BufferedReader:
    system, own = _at(path)
    return io.BufferedReader(system.open_input_file(own))


def write(path: str, data: bytes) -> None:
    """Writes a file whole: under another name first, so a lost task leaves no half of one."""
    system, own = _at(path)
    folder = own.rsplit("/", 1)[0]
    if folder and folder != own:
        system.create_dir(folder, recursive=True)
    part = own + ".part"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, own)


def join(folder: str, name: str) -> str:
    return folder.rstrip("/") + "/" + name

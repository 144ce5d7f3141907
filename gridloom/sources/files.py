"""Files by path or URI, for range reads on the driver and in tasks."""

from __future__ import annotations

import os

from pyarrow import fs


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def read_range(path: str, offset: int, length: int) -> bytes:
    f, p = open_fs(path)
    with f.open_input_file(p) as source:
        return source.read_at(length, offset)


def size_of(path: str) -> int:
    f, p = open_fs(path)
    info = f.get_file_info(p)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def is_dir(path: str) -> bool:
    f, p = open_fs(path)
    return f.get_file_info(p).type == fs.FileType.Directory


def publish(draft: str, target: str) -> None:
    """Moves a finished file to its place in one step; across devices by a copy beside the target."""
    try:
        os.replace(draft, target)
    except OSError:
        import shutil

        beside = f"{target}.{os.getpid()}.part"
        shutil.copyfile(draft, beside)
        os.replace(beside, target)
        os.unlink(draft)

"""Files of a store, by local path or by URI.

A path without a scheme, and ``file://``, is a folder that every executor mounts.
Any other URI (``s3://``, ``gs://``, ``abfs://``, ``hdfs://``) goes through
``pyarrow.fs`` inside the tasks: object stores by their own clients, Hadoop file
systems through libhdfs.  Names are listed as they are, hidden ones too.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import lru_cache
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

#: What an entry of a folder is.
FOLDER, FILE = "S", "F"


def local_path(path: str) -> str | None:
    """The path of a local file or folder; None where ``path`` is another store's URI."""
    scheme = urlsplit(path).scheme if "://" in path or path.startswith("file:") else ""
    if not scheme:
        return path
    return unquote(urlsplit(path).path) if scheme == "file" else None


def normal_root(root: str) -> str:
    """A store's root as it goes in front of relative paths."""
    path = local_path(root)
    return os.path.abspath(path) if path is not None else root.rstrip("/")


def join(root: str, rel: str) -> str:
    return root if rel == "." else f"{root.rstrip('/')}/{rel}"


@lru_cache(maxsize=64)
def _file_system(base: str):
    from pyarrow.fs import FileSystem
    return FileSystem.from_uri(base)[0]


def file_system(uri: str):
    """The file system of a URI and the path inside it.  Clients are kept for each
    authority, so a task opens one connection, not one for each file."""
    parts = urlsplit(uri)
    base = f"{parts.scheme}://{parts.netloc}/"
    inside = uri.split("://", 1)[1]
    if parts.scheme in ("hdfs", "viewfs", "mock"):
        inside = "/" + inside.split("/", 1)[1] if "/" in inside else "/"
    return _file_system(base), inside


def open_file(path: str) -> BinaryIO:
    """A seekable byte stream; an OSError where it cannot be read."""
    own = local_path(path)
    if own is not None:
        return open(own, "rb")
    fs, inside = file_system(path)
    return fs.open_input_file(inside)


def write_file(path: str, content: bytes) -> None:
    """A whole file, with the folders above it."""
    own = local_path(path)
    if own is not None:
        os.makedirs(os.path.dirname(own), exist_ok=True)
        with open(own, "wb") as f:
            f.write(content)
        return
    fs, inside = file_system(path)
    fs.create_dir(inside.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(inside) as f:
        f.write(content)


def remote_entries(uri: str) -> Iterator[tuple[str, str, int | None, datetime | None]]:
    """(name, kind, size, whole-second UTC time of change) of what lies directly under a
    URI.  The listing carries size and time, so files need no further request."""
    from pyarrow.fs import FileSelector, FileType
    fs, inside = file_system(uri)
    for info in fs.get_file_info(FileSelector(inside, recursive=False)):
        if info.type == FileType.Directory:
            yield info.base_name, FOLDER, None, None
        elif info.type == FileType.File:
            ns = info.mtime_ns
            when = None if ns is None else datetime.fromtimestamp(ns // 1_000_000_000, tz=timezone.utc).replace(tzinfo=None)
            yield info.base_name, FILE, info.size, when

"""Files that executors write and read themselves, in any file system that pyarrow opens by URI (file, hdfs, s3, gs)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it, of a whole address as storage.shared_dir gives it; Spark's file:/x counts as file:///x."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    if "://" not in uri:
        raise ValueError(f"{uri} names no file system")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def written(uri: str) -> Iterator:
    """A new file, there under its name only once it is whole; a task that runs again puts an equal file in its place."""
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(own, compression=None) as out:
            yield out
        system.move(own, path)
    except BaseException:
        if system.get_file_info(own).type != fs.FileType.NotFound:
            system.delete_file(own)
        raise


def read_stream(uri: str):
    system, path = opened(uri)
    return system.open_input_stream(path, compression=None)

"""Files below the shared folder, through pyarrow's file systems (local, HDFS, S3, GCS), from driver and executors."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


@contextmanager
def written(uri: str):
    """A stream whose content appears at uri as a whole or not at all; a repeated task replaces it by the same."""
    system, path = open_fs(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(temporary, compression=None) as out:
            yield out
        system.move(temporary, path)
    except BaseException:
        if system.get_file_info(temporary).type != fs.FileType.NotFound:
            system.delete_file(temporary)
        raise


@contextmanager
def opened(uri: str):
    system, path = open_fs(uri)
    with system.open_input_stream(path, compression=None) as stream:
        yield stream


@contextmanager
def seekable(uri: str):
    system, path = open_fs(uri)
    with system.open_input_file(path) as stream:
        yield stream

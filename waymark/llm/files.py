"""Whole files in the shared folder, by any path that pyarrow's file systems know."""

from __future__ import annotations

import uuid


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


def make_folder(uri: str) -> None:
    system, path = _open(uri)
    system.create_dir(path, recursive=True)


def remove_folder(uri: str) -> None:
    system, path = _open(uri)
    system.delete_dir(path)


def write_file(uri: str, data: bytes) -> None:
    """Write under another name and rename, so that a task that runs twice, or dies half-way,
    leaves a whole file or none. A repeated task writes the same bytes again."""
    system, path = _open(uri)
    part = f"{path.rpartition('/')[0]}/_part-{uuid.uuid4().hex}"
    with system.open_output_stream(part, compression=None) as out:
        out.write(data)
    system.move(part, path)


def read_file(uri: str) -> bytes:
    system, path = _open(uri)
    with system.open_input_stream(path, compression=None) as source:
        return source.read()

"""Whole binary files in a shared store, written by tasks so that a task may run twice or die half-way.

A file is written under a temporary name and renamed when complete, so readers never see a
torn file and a rerun of the task replaces it with the same bytes.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse


def _opened(folder: str):
    """(pyarrow file system, or None for a plain path, and the folder's path in it)."""
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        return None, unquote(url.path)
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class ShardFile:
    """Append bytes with :meth:`write`; :meth:`commit` makes the file visible under its final name."""

    def __init__(self, folder: str, name: str):
        self._fs, root = _opened(folder)
        if self._fs is None:
            os.makedirs(root, exist_ok=True)
        else:
            self._fs.create_dir(root, recursive=True)
        self._final = f"{root}/{name}"
        self._draft = f"{root}/_draft-{uuid.uuid4().hex}"
        self._out = open(self._draft, "wb") if self._fs is None else self._fs.open_output_stream(self._draft)  # noqa: SIM115
        self.size = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self._out.close()
        if self._fs is None:
            os.replace(self._draft, self._final)
        else:
            self._fs.move(self._draft, self._final)

    def discard(self) -> None:
        self._out.close()
        if self._fs is None:
            os.unlink(self._draft)
        else:
            self._fs.delete_file(self._draft)


def read_whole(folder: str, name: str) -> bytes | None:
    """The bytes of a committed file; None if there is none."""
    fs, root = _opened(folder)
    if fs is None:
        try:
            with open(f"{root}/{name}", "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None
    from pyarrow.fs import FileType

    if fs.get_file_info(f"{root}/{name}").type == FileType.NotFound:
        return None
    with fs.open_input_stream(f"{root}/{name}") as f:
        return f.read()

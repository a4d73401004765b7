"""Binary files by path: local, on any file system that Arrow knows (by URI), or by HTTP range requests."""

from __future__ import annotations

import io
import shutil
import tempfile
import urllib.request
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


class HttpFile(io.RawIOBase):
    """A seekable file on a server that answers range requests; a seek costs nothing until the next read."""

    def __init__(self, url: str):
        self.url, self.at = url, 0
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Range": "bytes=0-0"})) as answer:
            found = answer.headers.get("Content-Range")
            if not found or "/" not in found:
                raise OSError(f"{url}: the server does not answer range requests")
            self.size = int(found.rsplit("/", 1)[1])

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]
        return self.at

    def readinto(self, buffer) -> int:
        stop = min(self.size, self.at + len(buffer))
        if stop <= self.at:
            return 0
        asked = urllib.request.Request(self.url, headers={"Range": f"bytes={self.at}-{stop - 1}"})
        with urllib.request.urlopen(asked) as answer:
            data = answer.read()
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


def is_uri(path: str) -> bool:
    return "://" in path or path.startswith("file:")


def open_input(path: str):
    """A seekable binary file."""
    if path.startswith(("http://", "https://")):
        return io.BufferedReader(HttpFile(path), 1 << 16)
    if is_uri(path):
        store, name = fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])
        return store.open_input_file(name)
    return open(path, "rb")  # noqa: SIM115


@contextmanager
def save(path: str) -> Iterator:
    """A seekable file to write; on other file systems than the local one it is copied there when it is whole."""
    if not is_uri(path):
        with open(path, "wb") as out:
            yield out
        return
    with tempfile.TemporaryFile() as out:
        yield out
        out.seek(0)
        store, name = fs.FileSystem.from_uri(path)
        with store.open_output_stream(name) as target:
            shutil.copyfileobj(out, target, 1 << 20)

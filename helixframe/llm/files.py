"""Files in the shared folder, opened by any task through its URI."""

from __future__ import annotations

from pyarrow import fs


def split(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """A stream to a new file; its folder is made when it is missing."""
    system, path = split(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def read_range(uri: str, offset: int, length: int) -> bytes:
    system, path = split(uri)
    with system.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)


def read_tail(uri: str, length: int) -> tuple[bytes, int]:
    """Last bytes of a file, and its size."""
    system, path = split(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        f.seek(max(0, size - length))
        return f.read(length), size


def read_all(uri: str) -> bytes:
    system, path = split(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def delete(uri: str) -> None:
    system, path = split(uri)
    system.delete_file(path)

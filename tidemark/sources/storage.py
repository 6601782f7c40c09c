"""Bytes of files by URI, opened within tasks: any store that Arrow's file systems know, local paths included."""

from __future__ import annotations

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it; ``file:/x``, ``file:///x`` and ``/x`` are one."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), uri
    return (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(uri)


def open_input(uri: str):
    """A file to read from any place on."""
    system, path = resolve(uri)
    return system.open_input_file(path)


def open_output(uri: str):
    """A new file; folders above it are made where the store has any."""
    system, path = resolve(uri)
    if "/" in path:
        system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def size_of(uri: str) -> int:
    system, path = resolve(uri)
    return system.get_file_info(path).size

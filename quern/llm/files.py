"""Files in the shared folder, read and written from Python workers through pyarrow's filesystems."""

from __future__ import annotations

from pyarrow import fs


def open_filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path of a URI; a bare path is a local one."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put(uri: str, temporary: str, final: str) -> None:
    """Move a finished file in place; a file that another attempt of the task has left is replaced."""
    store, folder = open_filesystem(uri)
    if not isinstance(store, fs.LocalFileSystem) and store.get_file_info(f"{folder}/{final}").type != fs.FileType.NotFound:
        store.delete_file(f"{folder}/{final}")
    store.move(f"{folder}/{temporary}", f"{folder}/{final}")

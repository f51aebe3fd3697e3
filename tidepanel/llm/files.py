"""Files that tasks write into a folder all executors share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs


# Names Hadoop has for stores that go by another name here.
SAME_STORE = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def store_uri(uri: str) -> str:
    """The URI of a Spark path as the file systems below spell it; local ones come as file:/path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        return "file://" + uri.removeprefix("file:")
    scheme, mark, rest = uri.partition("://")
    if not mark:
        raise ValueError(f"{uri} names no file system")
    if scheme in ("wasb", "wasbs"):
        place, slash, path = rest.partition("/")
        rest = place.replace(".blob.", ".dfs.") + slash + path
    return f"{SAME_STORE.get(scheme, scheme)}://{rest}"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file.

    What pyarrow does not know is opened by fsspec where that is installed.  A path without a scheme is
    refused: Spark would look for it on the cluster's default file system, a task on its own disk.
    """
    whole = store_uri(uri)
    try:
        return fs.FileSystem.from_uri(whole)
    except pa.ArrowInvalid:
        import fsspec

        system, path = fsspec.core.url_to_fs(whole)
        return fs.PyFileSystem(fs.FSSpecHandler(system)), path


def new_name(stem: str, suffix: str) -> str:
    """A name no other attempt of the task uses, so that a repeated task never touches its first try.

    The rows the successful attempt returns are what says which files count.
    """
    return f"{stem}-{uuid.uuid4().hex}{suffix}"

"""Opening files inside tasks by the paths that Spark lists."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.fs as pa_fs


def open_path(path: str) -> pa.NativeFile:
    """The file at a path of Spark's ``path`` column, for reading and seeking in its own store."""
    scheme, authority, inside = re.fullmatch(r"(?:([a-z][a-z0-9+.-]*):(?://([^/]*))?)?(/.*)", path).groups()
    fs = pa_fs.LocalFileSystem() if scheme in (None, "file") else pa_fs.FileSystem.from_uri(f"{scheme}://{authority or ''}/")[0]
    return fs.open_input_file(inside if scheme in (None, "file", "hdfs", "viewfs") else f"{authority}{inside}")

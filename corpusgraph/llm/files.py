"""Binary files in the shared folder, written and read inside tasks.

Paths may belong to any file system that Arrow knows (local, HDFS, S3). A file is
written under a name of its own attempt; a task hands on the names it finished, so what
a lost or repeated attempt left behind is never read.
"""

from __future__ import annotations

import uuid


def open_fs(path: str):
    """``(file system, plain path)`` of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def create(folder: str, suffix: str):
    """A new file in ``folder``: its name and an output stream."""
    system, plain = open_fs(folder)
    system.create_dir(plain, recursive=True)
    name = f"part-{uuid.uuid4().hex}{suffix}"
    return name, system.open_output_stream(f"{plain}/{name}", compression=None)


def read(folder: str, name: str):
    """A random-access file in ``folder``."""
    system, plain = open_fs(folder)
    return system.open_input_file(f"{plain}/{name}")

"""Files of the shared folder as tasks read and write them (any store that pyarrow knows by its URI)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark import TaskContext


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it of a URI or an absolute path."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def replaced_file(uri: str) -> Iterator:
    """A new file that takes its name only once it is whole.

    Each attempt of a task writes under a name of its own and then renames, so a retried or speculative task leaves one
    whole file whichever attempt ends last.
    """
    fs, path = open_fs(uri)
    context = TaskContext.get()
    own = f"{path}.attempt-{context.taskAttemptId() if context else 0}"
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(own) as out:
        yield out
    fs.move(own, path)

"""Files that Python tasks write to and read from shared storage.

A task writes under a name of its own attempt and renames at the end, so a
repeated or speculative attempt leaves one whole file.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; `file:/x` as Hadoop prints it is accepted."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def committed(folder: str, *names: str):
    """Yield an output stream for each name; all are renamed into place on success."""
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    attempt = uuid.uuid4().hex
    drafts = [f"{path}/_{n}.{attempt}" for n in names]
    streams = [fs.open_output_stream(d, compression=None, buffer_size=1 << 20) for d in drafts]
    try:
        yield streams
    except BaseException:
        for s, d in zip(streams, drafts):
            s.close()
            fs.delete_file(d)
        raise
    for s, d, n in zip(streams, drafts, names):
        s.close()
        final = f"{path}/{n}"
        if fs.type_name == "hdfs" and fs.get_file_info(final).type != pafs.FileType.NotFound:
            fs.delete_file(final)
        fs.move(d, final)

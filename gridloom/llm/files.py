"""Binary files in the shared folder, written by tasks.

A task writes under another name and renames, so a file is whole or absent and
a task that is run again replaces it with the same bytes.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def write_file(folder: str, name: str, data: bytes) -> str:
    """Write ``data`` as ``folder/name``; ``folder`` is a URI that all executors share."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    aside = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as out:
        out.write(data)
    system.move(aside, f"{path}/{name}")
    return f"{folder}/{name}"

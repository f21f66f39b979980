"""Files in shared storage, written and read by tasks: whole files appear at once, under names that retries repeat."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, gs) or of a plain path."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[5:])
    return fs.LocalFileSystem(), uri


class Output:
    """A file that is seen under its name only when complete; a second attempt's file replaces the first's."""

    def __init__(self, folder: str, name: str):
        self.fs, self.folder = open_store(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.path, self.tmp = f"{self.folder}/{name}", f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.tmp)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.path)

    def abort(self) -> None:
        self.out.close()
        self.fs.delete_file(self.tmp)


def listing(folder: str, ending: str) -> list[tuple[str, int]]:
    """Name and size of each complete file of a folder, by name."""
    store, path = open_store(folder)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.base_name.endswith(ending) and not f.base_name.startswith("."))

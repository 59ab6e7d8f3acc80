"""Files under a URL that all executors reach."""

from __future__ import annotations

import io
import os
import uuid

import numpy as np


class Folder:
    """A mounted folder for file: URLs, else a pyarrow file system."""

    def __init__(self, url: str):
        if url.startswith("file:") or "://" not in url:
            self.fs, self.root = None, "/" + url.removeprefix("file:").lstrip("/")
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(url)

    def write(self, name: str, data: bytes) -> None:
        """Write under a temporary name, then rename."""
        path, temporary = f"{self.root}/{name}", f"{self.root}/_temporary.{uuid.uuid4().hex}.{name}"
        if self.fs is None:
            os.makedirs(self.root, exist_ok=True)
            with open(temporary, "wb") as out:
                out.write(data)
                out.flush()
                os.fsync(out.fileno())
            os.replace(temporary, path)
        else:
            with self.fs.open_output_stream(temporary) as out:
                out.write(data)
            self.fs.move(temporary, path)

    def read(self, name: str) -> bytes:
        if self.fs is None:
            with open(f"{self.root}/{name}", "rb") as f:
                return f.read()
        with self.fs.open_input_stream(f"{self.root}/{name}") as f:
            return f.read()

    def exists(self, name: str) -> bool:
        if self.fs is None:
            return os.path.exists(f"{self.root}/{name}")
        from pyarrow import fs

        return self.fs.get_file_info(f"{self.root}/{name}").type != fs.FileType.NotFound

    def array(self, name: str) -> np.ndarray | None:
        """An array that np.save wrote, None where there is none: mapped into memory on a mounted folder, read into the worker's memory elsewhere. Nothing is copied to a local disk."""
        if not self.exists(name):
            return None
        return np.load(f"{self.root}/{name}", mmap_mode="r") if self.fs is None else np.load(io.BytesIO(self.read(name)))

    def sweep(self) -> None:
        """Remove what dead attempts left under temporary names."""
        if self.fs is None:
            for name in os.listdir(self.root):
                if name.startswith("_temporary."):
                    os.remove(f"{self.root}/{name}")
            return
        from pyarrow import fs

        for info in self.fs.get_file_info(fs.FileSelector(self.root)):
            if info.base_name.startswith("_temporary."):
                self.fs.delete_file(info.path)

"""Files of any store that pyarrow reaches: local ones, HDFS, S3 and the like."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow.fs as pf

WILD = re.compile(r"[*?\[]")


def store_of(path: str) -> tuple[pf.FileSystem, str, str]:
    """(the store, the path within it, what comes before that path in a file's name)."""
    if "://" not in path or path.startswith("file:"):
        inner = re.sub("^file:/+", "/", path)
        return pf.LocalFileSystem(), inner, path[: len(path) - len(inner)] if path.startswith("file:") else ""
    store, inner = pf.FileSystem.from_uri(quote(path, safe=":/@"))
    return store, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def open_file(path: str) -> pf.FileSystem:
    """A file's stream with random access; only what is read is fetched."""
    store, inner, _ = store_of(path)
    return store.open_input_file(inner)


def listed(path: str) -> Iterator[tuple[str, int, int]]:
    """(name, size, time of change in ns) of a file, of a folder's files, or of a pattern's, by name."""
    store, inner, before = store_of(path)
    if not WILD.search(inner):
        info = store.get_file_info(inner)
        found = store.get_file_info(pf.FileSelector(inner)) if info.type == pf.FileType.Directory else [info]
    else:
        # the folder above the first wildcard; `*` stays within one folder
        steps = inner.split("/")
        first = next(k for k, s in enumerate(steps) if WILD.search(s))
        selector = pf.FileSelector("/".join(steps[:first]) or "/", allow_not_found=True, recursive=first < len(steps) - 1)
        fits = lambda name: len(own := name.split("/")) == len(steps) and all(map(fnmatch.fnmatchcase, own, steps))
        found = [f for f in store.get_file_info(selector) if fits(f.path)]
    for info in sorted(found, key=lambda f: f.path):
        if info.type == pf.FileType.File:
            yield before + info.path, info.size, info.mtime_ns or 0


def read_text(path: str) -> str | None:
    """A small file's text; None if there is none."""
    store, inner, _ = store_of(path)
    if store.get_file_info(inner).type != pf.FileType.File:
        return None
    with store.open_input_file(inner) as file:
        return file.read().decode("utf-8")


def write_bytes(path: str, body: bytes) -> None:
    """Replace a file as a whole, its folder made where there is none."""
    store, inner, _ = store_of(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    with store.open_output_stream(f"{inner}.new") as file:
        file.write(body)
    store.move(f"{inner}.new", inner)

"""Files behind a path or URI, for code that runs in tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs


def open_filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    local = re.sub(r"^file:/+", "/", path)
    filesystem, found = fs.FileSystem.from_uri(local)
    return filesystem, found.rstrip("/")


def read_file(path: str) -> bytes:
    filesystem, found = open_filesystem(path)
    with filesystem.open_input_stream(found) as stream:
        return stream.read()


def _pattern(glob: str) -> re.Pattern:
    """``*`` and ``?`` stay within one part of a path."""
    return re.compile("".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in glob))


def list_sizes(glob: str) -> Iterator[tuple[str, int]]:
    """(path, size) of the files a glob matches, or of all files below a folder, by path."""
    filesystem, pattern = open_filesystem(glob)
    fixed = re.split(r"[*?]", pattern, maxsplit=1)[0]
    if fixed == pattern:
        info = filesystem.get_file_info(pattern)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no such input: {glob}")
        if info.is_file:
            yield info.path, info.size
            return
        base, match = pattern, None
    else:
        base, match = fixed.rsplit("/", 1)[0] or "/", _pattern(pattern)
    found = filesystem.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
    for info in sorted((i for i in found if i.is_file), key=lambda i: i.path):
        if match is None or match.fullmatch(info.path):
            yield info.path, info.size

"""Files on a mount or in an object store: lists and open files, for sources that read parts of files."""

from __future__ import annotations

import re
from fnmatch import fnmatchcase

from pyarrow import NativeFile, fs


def located(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path or URI, the path inside it, and what the name has before that path."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    path = path.rstrip("/") or "/"
    if "://" not in path:
        return fs.LocalFileSystem(), re.sub(r"^file:", "", path), ""
    system, inside = fs.FileSystem.from_uri(path)
    return system, inside, path.removesuffix(inside)


def find(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(name, bytes) of a file, of a folder's files with this suffix, or of those that a pattern picks, by name.

    ``*``, ``?`` and ``[...]`` stay inside one part of the path.  Names that start with a dot are left out.
    """
    parts = path.rstrip("/").split("/")
    plain = next((k for k, part in enumerate(parts) if set(part) & set("*?[")), len(parts))
    wild = parts[plain:]
    system, base, before = located("/".join(parts[:plain]) or ("/" if path.startswith("/") else "."))
    if not wild:
        info = system.get_file_info(base)
        if info.type == fs.FileType.File:
            return [(before + base, info.size)]
        wild = [f"*{suffix}"]
    listed = system.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=len(wild) > 1))
    out = []
    for info in listed:
        inside = info.path.removeprefix(base).lstrip("/").split("/")
        fits = len(inside) == len(wild) and all(map(fnmatchcase, inside, wild))
        if fits and info.type == fs.FileType.File and not any(part.startswith(".") for part in inside):
            out.append((before + info.path, info.size))
    return sorted(out)


def open_file(name: str) -> NativeFile:
    """A file open for reading at any offset."""
    system, inside, _ = located(name)
    return system.open_input_file(inside)


def make_folder(path: str) -> None:
    system, inside, _ = located(path)
    system.create_dir(inside, recursive=True)


def write_file(name: str, data: bytes, part: str) -> None:
    """Write under the name ``part`` first, so that no reader and no second attempt sees half a file."""
    system, inside, _ = located(name)
    held = f"{inside}.{part}.part"
    with system.open_output_stream(held) as file:
        file.write(data)
    system.move(held, inside)


def open_new(name: str) -> NativeFile:
    """A file open for writing from its start on."""
    system, inside, _ = located(name)
    return system.open_output_stream(inside)


def move_file(name: str, to: str) -> None:
    system, inside, _ = located(name)
    system.move(inside, located(to)[1])


def delete_folder(path: str) -> None:
    """A folder and all in it; nothing where there is none."""
    system, inside, _ = located(path)
    if system.get_file_info(inside).type == fs.FileType.Directory:
        system.delete_dir(inside)

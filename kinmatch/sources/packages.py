"""Archives of results, on the driver: built from a manifest, safe paths only, verified by digest."""

from __future__ import annotations

import hashlib
import platform
import sys
import zipfile
from pathlib import Path, PurePosixPath


def digest(path: Path) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def safe_name(name: str) -> str:
    parts = PurePosixPath(name).parts
    if not parts or name.startswith("/") or "\\" in name or ":" in name or ".." in parts:
        raise ValueError(f"unsafe name in an archive: {name!r}")
    return name


def build(files: dict[str, Path], out: Path) -> dict[str, str]:
    """files maps names in the archive to files; returns their digests. The archive must not exist."""
    told = {safe_name(name): digest(path) for name, path in files.items()}
    with zipfile.ZipFile(out, "x", zipfile.ZIP_DEFLATED) as archive:
        for name, path in files.items():
            archive.write(path, name)
    return told


def verify(out: Path, told: dict[str, str]) -> None:
    with zipfile.ZipFile(out) as archive:
        names = archive.namelist()
        if len(names) != len(set(names)) or set(names) != set(told) or archive.testzip() is not None:
            raise ValueError("the archive's names or checksums are not those of the manifest")
        for name in names:
            if hashlib.sha256(archive.read(name)).hexdigest() != told[safe_name(name)]:
                raise ValueError(f"{name} has changed")


def environment() -> dict[str, str]:
    return {"python": sys.version.split()[0], "platform": platform.platform()}

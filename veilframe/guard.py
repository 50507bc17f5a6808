"""What paths the tools may touch, and which formats can be written."""

from __future__ import annotations

import os
import stat
from pathlib import Path

from veilframe.sources import formats


class Refused(ValueError):
    """A request that is not carried out; its message holds no restored value."""


def check_path(path: str, roots: tuple[str, ...] = ()) -> Path:
    """The absolute path, if it leads to a regular file, or a place for one, within the roots (none: anywhere).

    The nearest existing folder is resolved first, so neither `..` nor a link walks out of a root, for files that
    don't exist yet as well.
    """
    asked = Path(os.path.abspath(os.path.join(os.getcwd(), path)))
    resolved = Path(os.path.realpath(os.path.join(os.getcwd(), path)))
    for p in (asked, resolved):
        if p.parts[:2] in (("/", "dev"), ("/", "proc")):
            raise Refused(f"{path} leads to a device or a process; only files on disk are written")
    if resolved.exists():
        mode = resolved.stat().st_mode
        if not (stat.S_ISREG(mode) or stat.S_ISDIR(mode)):
            raise Refused(f"{path} is a pipe, socket or the like; only files on disk are written, so that nobody reads values from it")
    if roots and not any(resolved.is_relative_to(os.path.realpath(r)) for r in roots):
        raise Refused(f"{path} lies under none of the allowed roots")
    return resolved


def check_writable_format(path: str | Path, whole: bool) -> None:
    """Pictures and PDFs can't be written; an Office document can be edited, but not replaced as a whole."""
    kind = formats.format_of(str(path))
    if kind == "image":
        raise Refused(f"{path} is a picture, and pictures are only read; change the file it was made from")
    if kind == "pdf":
        raise Refused(f"{path} is a PDF, and PDFs are only read; change the file it was made from")
    if kind == "ooxml" and whole:
        raise Refused(f"{path} is an Office document and would lose its markup; use edit_restored for single changes")

"""Which files make up a journal: listing of roots, and one file for each file id."""

from __future__ import annotations

import logging
import os
import sys

from brindle.plans.model import InvalidQuery, JournalError, LimitExceeded, Limits, NotFound, Unsupported
from brindle.sources.format import JournalFile

log = logging.getLogger(__name__)

DEFAULT_ROOTS = ("/run/log/journal", "/var/log/journal")
_HEX = frozenset("0123456789abcdefABCDEF")


def default_roots() -> list[str]:
    if sys.platform != "linux":
        raise Unsupported("default roots exist on Linux only")
    return list(DEFAULT_ROOTS)


def list_files(roots: list[str], limits: Limits) -> list[str]:
    """*.journal in each root and in its subfolders of 32 hex digits; no links. Sorted, each once.

    A root that can't be read is passed over if another has files.
    """
    if not roots:
        raise InvalidQuery("no journal roots")
    suffixes = (".journal", ".journal~") if limits.include_tilde_files else (".journal",)
    found: set[str] = set()
    error: OSError | None = None
    for root in roots:
        try:
            entries = list(os.scandir(root))
        except OSError as e:
            error = error or e
            continue
        for e in entries:
            if e.is_file(follow_symlinks=False) and e.name.endswith(suffixes):
                found.add(e.path)
            elif e.is_dir(follow_symlinks=False) and len(e.name) == 32 and _HEX.issuperset(e.name):
                try:
                    found.update(x.path for x in os.scandir(e.path) if x.is_file(follow_symlinks=False) and x.name.endswith(suffixes))
                except OSError as err:
                    error = error or err
    if not found and error is not None:
        raise NotFound(f"no journal files: {error}")
    if len(found) > limits.max_journal_files:
        raise LimitExceeded("journal files", limits.max_journal_files)
    return sorted(os.path.normpath(p) for p in found)


def usable(paths: list[str], limits: Limits) -> list[tuple[str, JournalFile]]:
    """(path, header) of files that open, the first by path for each file id. If none opens, the first error."""
    out: dict[bytes, tuple[str, object]] = {}
    error: JournalError | None = None
    for p in paths:
        try:
            with JournalFile(p, limits) as f:
                out.setdefault(f.header.file_id, (p, f.header))
        except JournalError as e:
            log.warning("%s is left out: %s", p, e)
            error = error or e
    if not out:
        raise error or NotFound("no journal files")
    return list(out.values())

"""Durable single files: written beside, synced, renamed, folder synced.

Bulk data goes through Spark's own commit protocol; this is for the few small files
whose rename makes a version visible.
"""

from __future__ import annotations

import os
import stat
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from lodestore.functions.errors import Fault, StoreError

TEMPORARY = ".tmp-"
#: All prefixes of files that a crash may leave behind.
LEFTOVERS = (TEMPORARY, ".durable-tmp-", ".fast-blob-", ".fast-record-")


@dataclass
class FileOps:
    """The system calls a writer uses, replaceable in tests."""

    open: Callable = os.open
    write: Callable = os.write
    fsync: Callable = os.fsync
    close: Callable = os.close
    replace: Callable = os.replace
    unlink: Callable = os.unlink


@dataclass
class Hooks:
    """Calls ``at[point]()`` when a write passes a named point; tests raise there."""

    at: dict[str, Callable[[], None]] = field(default_factory=dict)

    def __call__(self, point: str) -> None:
        if point in self.at:
            self.at[point]()


def sync_folder(folder: str, ops: FileOps | None = None) -> None:
    ops = ops or FileOps()
    handle = ops.open(folder, os.O_RDONLY | os.O_DIRECTORY | os.O_CLOEXEC)
    try:
        ops.fsync(handle)
    finally:
        ops.close(handle)


def write_all(handle: int, data: bytes, ops: FileOps) -> None:
    view = memoryview(data)
    while view:
        n = ops.write(handle, view)
        if n <= 0:
            raise StoreError(Fault.STORAGE_UNAVAILABLE, "a write made no progress")
        view = view[n:]


def write_temporary(folder: str, data: bytes, ops: FileOps | None = None, prefix: str = TEMPORARY, hooks: Hooks | None = None, what: str = "file") -> str:
    """A synced private file with a name of its own; nothing is left after a failure."""
    ops, hooks = ops or FileOps(), hooks or Hooks()
    path = os.path.join(folder, prefix + uuid.uuid4().hex)
    handle = ops.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW | os.O_CLOEXEC, 0o600)
    try:
        try:
            write_all(handle, data, ops)
            hooks(f"after {what} written")
            ops.fsync(handle)
            hooks(f"after {what} synced")
        finally:
            ops.close(handle)
    except BaseException:
        ops.unlink(path)
        raise
    return path


def write_replacing(path: str, data: bytes, ops: FileOps | None = None, hooks: Hooks | None = None) -> None:
    """Replace ``path`` in one step: readers see the old bytes or the new. If only the
    last sync of the folder fails the new value is visible and the error is raised."""
    ops, hooks = ops or FileOps(), hooks or Hooks()
    folder = os.path.dirname(path)
    hooks("before write")
    temporary = write_temporary(folder, data, ops, hooks=hooks, what="record")
    try:
        hooks("before rename")
        ops.replace(temporary, path)
    except BaseException:
        ops.unlink(temporary)
        raise
    hooks("after rename")
    sync_folder(folder, ops)
    hooks("after sync")


def secure_folder(path: str) -> None:
    """Make the folder if needed; it must be ours, private and no link."""
    try:
        os.mkdir(path, 0o700)
    except FileExistsError:
        pass
    found = os.lstat(path)
    if not stat.S_ISDIR(found.st_mode) or found.st_uid != os.geteuid():
        raise StoreError(Fault.INSECURE_PATH, path)
    if stat.S_IMODE(found.st_mode) != 0o700:
        os.chmod(path, 0o700)


def check_file(path: str) -> os.stat_result:
    """A regular file of ours with one name and mode 0600; anything else is refused."""
    found = os.lstat(path)
    if not stat.S_ISREG(found.st_mode) or found.st_nlink != 1 or found.st_uid != os.geteuid() or stat.S_IMODE(found.st_mode) != 0o600:
        raise StoreError(Fault.INSECURE_PATH, path)
    return found


def modified_at(path: str) -> float | None:
    try:
        return check_file(path).st_mtime
    except (OSError, StoreError):
        return None


def is_invalid_path(error: OSError) -> bool:
    import errno

    return error.errno in (errno.ENOENT, errno.ELOOP, errno.ENOTDIR)

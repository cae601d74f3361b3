"""The engine's errors and limits."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Fault(Enum):
    """Stable causes, also the values of a batch result's ``error`` column."""

    INVALID_ARGUMENT = "invalidArgument"
    NOT_FOUND = "notFound"
    LIMIT_EXCEEDED = "limitExceeded"
    INTEGRITY_MISMATCH = "integrityMismatch"
    INVALID_MANIFEST = "invalidManifest"
    UNSUPPORTED_SCHEMA = "unsupportedSchema"
    STORAGE_UNAVAILABLE = "storageUnavailable"
    TRANSACTION_CONFLICT = "transactionConflict"
    INSECURE_PATH = "insecurePath"


class StoreError(Exception):
    def __init__(self, fault: Fault, detail: str = "") -> None:
        super().__init__(f"{fault.value}: {detail}" if detail else fault.value)
        self.fault = fault


MIB = 1 << 20
#: Fixed caps of the store.
SOFT_BYTES_CAP, BLOB_BYTES_CAP, DIRECTORY_CAP = 1 << 40, 1 << 30, 1_000_000
ENTRY_CAP, RECORD_CAP = 100_000, 512
SNAPSHOT_BYTES, RECORD_BYTES = 64 * MIB, 16 * 1024


def clamp(value: int, cap: int) -> int:
    return min(cap, max(1, value))


@dataclass(frozen=True)
class StoreLimits:
    """Limits of a store; each is kept between 1 and its cap, a blob's under the soft limit."""

    soft_bytes: int = 128 * MIB
    blob_bytes: int = 64 * MIB
    directory_entries: int = 201_024

    def __post_init__(self) -> None:
        object.__setattr__(self, "soft_bytes", clamp(self.soft_bytes, SOFT_BYTES_CAP))
        object.__setattr__(self, "blob_bytes", min(self.soft_bytes, clamp(self.blob_bytes, BLOB_BYTES_CAP)))
        object.__setattr__(self, "directory_entries", clamp(self.directory_entries, DIRECTORY_CAP))


@dataclass(frozen=True)
class MaintenanceLimits:
    """The most live references, and bytes in them, that maintenance accepts."""

    references: int
    total_bytes: int

    def __post_init__(self) -> None:
        if self.references <= 0 or self.total_bytes <= 0:
            raise StoreError(Fault.INVALID_ARGUMENT, "limits must be positive")

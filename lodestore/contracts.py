"""What the engine's stores promise, as structural types."""

from __future__ import annotations

from typing import Any, Protocol, runtime_checkable


@runtime_checkable
class BlobStoring(Protocol):
    """Content-addressed payloads, by digest and partition."""

    def commit(self, data: bytes, digest: str, partition: bytes) -> Any: ...

    def read(self, digest: str, partition: bytes) -> bytes: ...

    def remove(self, digest: str, partition: bytes) -> bool: ...


@runtime_checkable
class TransactionalBlobStoring(BlobStoring, Protocol):
    """Payloads that are written first and made visible, or forgotten, later."""

    def stage(self, data: bytes, digest: str, partition: bytes) -> str: ...

    def publish(self, token: str) -> Any: ...

    def discard(self, token: str) -> None: ...


@runtime_checkable
class BlobStoreMaintaining(Protocol):
    """Removal of what nothing refers to, and of whole partitions."""

    def collect(self, live: set, limits: Any) -> Any: ...

    def remove_partition(self, partition: bytes) -> Any: ...


@runtime_checkable
class StoreGenerationManaging(Protocol):
    """Stores side by side, of which one is current."""

    def open(self, fingerprint: str) -> Any: ...

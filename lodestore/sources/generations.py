"""Store generations: folders with a descriptor each, and one pointer to the current."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from dataclasses import dataclass

from lodestore.functions.errors import Fault, StoreError
from lodestore.functions.identity import plain_fingerprint
from lodestore.sources import durable
from lodestore.sources.durable import FileOps, Hooks
from lodestore.sources.lease import cross_process_lock
from lodestore.sources.payloads import list_bounded, read_bounded

SCHEMA = 1
FILE_BYTES = 64 * 1024
MOST_GENERATIONS = 10_000
PREFIX = "generation-"


def normal_fingerprint(text: str) -> str:
    bare = plain_fingerprint(text)
    if bare is None:
        raise StoreError(Fault.INVALID_ARGUMENT, "fingerprint")
    return bare


@dataclass(frozen=True)
class Generation:
    identifier: str
    fingerprint: str
    created_at: float
    folder: str


class GenerationManager:
    """Opens the generation that fits a fingerprint: the current one, else the newest,
    else a new one. The pointer's rename is the switch; old generations stay."""

    def __init__(self, root: str, ops: FileOps | None = None, hooks: Hooks | None = None) -> None:
        self.root, self.ops, self.hooks = root, ops or FileOps(), hooks or Hooks()
        durable.secure_folder(root)

    def open(self, fingerprint: str) -> Generation:
        fingerprint = normal_fingerprint(fingerprint)
        with cross_process_lock(self.root):
            found = self._all()
            current = self._current(found)
            if current is not None and current.fingerprint == fingerprint:
                return current
            fits = [g for g in found.values() if g.fingerprint == fingerprint]
            best = max(fits, key=lambda g: (g.created_at, g.identifier), default=None) or self._create(fingerprint)
            self._point(best)
            return best

    def _read(self, path: str) -> dict:
        data = json.loads(read_bounded(path, FILE_BYTES))
        if not isinstance(data, dict) or not isinstance(data.get("schemaVersion"), int):
            raise StoreError(Fault.INVALID_MANIFEST, path)
        if data["schemaVersion"] > SCHEMA:
            raise StoreError(Fault.UNSUPPORTED_SCHEMA, path)
        if data["schemaVersion"] != SCHEMA:
            raise StoreError(Fault.INVALID_MANIFEST, path)
        return data

    def _all(self) -> dict[str, Generation]:
        """The sound generations; one without a descriptor is what a crash left and
        goes, one of an unknown schema stays untouched."""
        out = {}
        for name in list_bounded(self.root, MOST_GENERATIONS):
            folder = os.path.join(self.root, name)
            if name.startswith(durable.TEMPORARY):
                self.ops.unlink(folder)
                continue
            if not re.fullmatch(PREFIX + r"[0-9a-f-]{36}", name) or os.path.islink(folder):
                continue
            path = os.path.join(folder, "generation.json")
            if not os.path.exists(path):
                for left in list_bounded(folder, MOST_GENERATIONS):
                    if left.startswith(durable.TEMPORARY):
                        self.ops.unlink(os.path.join(folder, left))
                if not os.listdir(folder):
                    os.rmdir(folder)
                continue
            try:
                data = self._read(path)
                sound = Generation(data["identifier"], normal_fingerprint(data["compatibilityFingerprint"]), float(data["createdAt"]), folder)
            except (StoreError, ValueError, KeyError, TypeError):
                continue
            if name == PREFIX + sound.identifier:
                out[sound.identifier] = sound
        return out

    def _current(self, found: dict[str, Generation]) -> Generation | None:
        path = os.path.join(self.root, "current-generation.json")
        try:
            data = self._read(path)
        except FileNotFoundError:
            return None
        except ValueError:
            return None
        except StoreError as error:
            if error.fault is Fault.UNSUPPORTED_SCHEMA:
                raise
            return None
        named = found.get(data.get("identifier"))
        return named if named and named.fingerprint == data.get("compatibilityFingerprint") else None

    def _create(self, fingerprint: str) -> Generation:
        identifier = str(uuid.uuid4())
        folder = os.path.join(self.root, PREFIX + identifier)
        durable.secure_folder(folder)
        created = time.time()
        data = {"schemaVersion": SCHEMA, "identifier": identifier, "compatibilityFingerprint": fingerprint, "createdAt": created}
        self.hooks("before descriptor")
        durable.write_replacing(os.path.join(folder, "generation.json"), json.dumps(data, sort_keys=True).encode(), self.ops)
        durable.sync_folder(self.root, self.ops)
        return Generation(identifier, fingerprint, created, folder)

    def _point(self, generation: Generation) -> None:
        data = {"schemaVersion": SCHEMA, "identifier": generation.identifier, "compatibilityFingerprint": generation.fingerprint}
        self.hooks("before pointer")
        durable.write_replacing(os.path.join(self.root, "current-generation.json"), json.dumps(data, sort_keys=True).encode(), self.ops, self.hooks)

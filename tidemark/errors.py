"""Errors, their classification, and retries."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


class KvError(Exception):
    kind = "Internal"


class InvalidKey(KvError):
    kind = "InvalidKey"


class InvalidValue(KvError):
    kind = "InvalidValue"


class KeyNotFound(KvError):
    kind = "KeyNotFound"


class StorageError(KvError):
    kind = "Storage"


class StorageIoError(KvError):
    kind = "Io"


class SerializationError(KvError):
    kind = "Serialization"


class OperationTimeout(KvError):
    kind = "Timeout"


class ConfigError(KvError):
    kind = "Config"


class InvalidConfiguration(KvError):
    kind = "InvalidConfiguration"


class EncryptionError(KvError):
    kind = "Encryption"


class CommitConflict(StorageError):
    """Another writer has committed the version first."""


class ColumnFamilyNotFound(StorageError):
    def __init__(self, name: str) -> None:
        super().__init__(f"Column family not found: {name}")


class Unsupported(KvError):
    """Interactive transactions and the like."""


KINDS = {c.kind: c for c in (KvError, InvalidKey, InvalidValue, KeyNotFound, StorageError, StorageIoError, SerializationError, OperationTimeout, ConfigError, InvalidConfiguration, EncryptionError)}
#: Kinds that keep their type when context is added; the others become internal errors.
_KEEP = {"InvalidKey", "InvalidValue", "Storage", "Io", "Serialization", "Timeout", "Config"}

#: Fixed values but for the hints. kind: (severity when handled, recoverable, strategy, logged, reported, severity as seen by
#: users, hint).
CLASSES = {
    "InvalidKey": ("Medium", False, "Fail", True, False, "Low", "Is the key empty, too long, or of the wrong pattern?"),
    "InvalidValue": ("Medium", False, "Fail", True, False, "Low", "Is the value of one of the eight variants, and within its limits?"),
    "KeyNotFound": ("Low", False, "Skip", False, False, "Low", "Nothing is stored under this key now"),
    "Storage": ("High", True, "Retry", True, True, "High", "Look at the health check, and for runs that are missing"),
    "Io": ("High", True, "Retry", True, True, "High", "Can the folder be read and written, and is there room?"),
    "Timeout": ("High", True, "Retry", True, True, "High", "Try once more, or allow more time"),
    "Serialization": ("Critical", False, "Fail", True, True, "Medium", "Was this written by another format or version?"),
    "Config": ("Critical", False, "Fail", True, True, "Medium", "Config.problems() lists what is wrong"),
    "InvalidConfiguration": ("Critical", False, "Fail", True, True, "Medium", "A setting has a value that can't work; see the message"),
    "Encryption": ("Critical", False, "Fail", True, True, "High", "Is it the key that the data was written with?"),
    "Internal": ("Critical", False, "Fail", True, True, "Critical", "This is a fault of the store itself; please report it"),
}
#: What users read, by the storage layer's own kinds of errors.
MESSAGES = {
    "Io": "Storage I/O error",
    "Serialization": "Data format error",
    "Corruption": "Data corruption detected",
    "Config": "Configuration error",
    "Compaction": "Storage optimization error",
    "Wal": "Recovery error",
    "BloomFilter": "Index error",
    "Compression": "Compression error",
    "KeyNotFound": "Key not found",
    "ColumnFamilyNotFound": "Column family not found",
    "InvalidOperation": "Invalid operation",
    "ResourceLimit": "Resource limit",
    "Internal": "Internal error",
}
ENGINE_RECOVERABLE = ("Io", "Compaction", "Wal")


def error_dimension(spark: SparkSession) -> DataFrame:
    """One row for each kind, to be joined (it has eleven rows, so it is broadcast by its size)."""
    return spark.createDataFrame([(k, *x) for k, x in CLASSES.items()], "kind string, severity string, recoverable boolean, strategy string, should_log boolean, should_report boolean, user_severity string, hint string")


def user_message(kind: str, detail: str) -> str:
    return f"{MESSAGES.get(kind, MESSAGES['Internal'])}: {detail}"


def with_context(error: KvError, context: str | Callable[[], str]) -> KvError:
    """The error with ``context: `` before its message."""
    text = f"{context() if callable(context) else context}: {error}"
    made = (KINDS[error.kind] if error.kind in _KEEP else KvError)(text)
    made.__cause__ = error
    return made


def retry(operation: Callable[[], T], retries: int = 3, delay: float = 0.1, most: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """``operation()``, tried again while its error is recoverable, after 0.1, 0.2, 0.4 ... seconds, ``most`` at most."""
    for attempt in range(retries + 1):
        try:
            return operation()
        except KvError as e:
            if attempt == retries or not CLASSES[e.kind][1]:
                raise
            sleep(min(delay * 2**attempt, most))
    raise AssertionError


def handle(error: KvError, operation: Callable[[], T], retries: int = 3, delay: float = 0.1, sleep: Callable[[float], None] = time.sleep) -> T:
    """Acts on an error by its class: tries the operation again, skips it, or fails."""
    _, recoverable, strategy, *_ = CLASSES[error.kind]
    if strategy == "Retry" and recoverable:
        return retry(operation, max(0, retries - 1), delay, sleep=sleep)
    if strategy == "Skip":
        raise KvError(f"skipped: {error}") from error
    raise error

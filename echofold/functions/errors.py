"""One exception with a kind and a stable numeric code."""

from __future__ import annotations

#: Kind -> (code, message id, summary).
KINDS = {
    "InvalidConfiguration": (2, "E_INVALID_CONFIG", "invalid configuration"),
    "UnsupportedVersion": (3, "E_UNSUPPORTED_VERSION", "unsupported archive version"),
    "UnsupportedLegacySplitIndex": (4, "E_SPLIT_INDEX", "external legacy index is unsupported"),
    "UnknownChecksum": (5, "E_UNKNOWN_CHECKSUM", "unknown checksum"),
    "CorruptHeader": (6, "E_CORRUPT_HEADER", "corrupt archive header"),
    "TruncatedArchive": (7, "E_TRUNCATED", "truncated archive"),
    "CorruptRecord": (8, "E_CORRUPT_RECORD", "corrupt archive record"),
    "CorruptIndex": (9, "E_CORRUPT_INDEX", "corrupt embedded index"),
    "InvalidMatch": (10, "E_INVALID_MATCH", "invalid match"),
    "ChecksumMismatch": (11, "E_CHECKSUM", "checksum mismatch"),
    "OutputLimitExceeded": (12, "E_OUTPUT_LIMIT", "output limit exceeded"),
    "MemoryBudgetExceeded": (13, "E_MEMORY_LIMIT", "memory budget exceeded"),
    "TempBudgetExceeded": (14, "E_TEMP_LIMIT", "temporary budget exceeded"),
    "NonSeekableNeedsSpool": (15, "E_NEEDS_SPOOL", "seekable input or spool required"),
    "TemporaryStorageFailure": (16, "E_TEMP_STORAGE", "temporary storage failure"),
    "InputIo": (17, "E_INPUT_IO", "input I/O failure"),
    "OutputIo": (18, "E_OUTPUT_IO", "output I/O failure"),
    "AtomicPublish": (19, "E_ATOMIC_PUBLISH", "atomic publication failed"),
}


class EngineError(ValueError):
    """``kind`` is a key of ``KINDS``; ``code`` its number."""

    def __init__(self, kind: str, detail: str = ""):
        self.kind, self.detail = kind, detail
        self.code, self.message_id, summary = KINDS[kind]
        super().__init__(f"{summary}: {detail}" if detail else summary)

    def __reduce__(self):
        return EngineError, (self.kind, self.detail)

"""Failures of the engine, and the public kinds that a server reports them as."""

from __future__ import annotations


class EngineError(ValueError):
    """Raised with one of the names of PUBLIC_KIND."""

    def __init__(self, name: str, detail: str = ""):
        super().__init__(f"{name}: {detail}" if detail else name)
        self.name = name

    @property
    def public_kind(self) -> str:
        return PUBLIC_KIND.get(self.name, "internal")


#: The public kind of each engine error.
PUBLIC_KIND = {
    "invalid_magic": "corrupt_archive",
    "invalid_range": "corrupt_archive",
    "overlapping_sections": "corrupt_archive",
    "missing_section": "corrupt_archive",
    "duplicate_section": "corrupt_archive",
    "invalid_metadata": "corrupt_archive",
    "checksum_mismatch": "integrity_mismatch",
    "hash_mismatch": "integrity_mismatch",
    "unsupported_container_version": "unsupported_format",
    "unsupported_codec": "unsupported_feature",
    "unsupported_file_type": "unsupported_feature",
    "unsafe_path": "unsafe_path",
    "unsafe_symlink": "unsafe_path",
    "resource_limit": "resource_limit",
    "memory_limit": "resource_limit",
    "temporary_space_limit": "resource_limit",
    "integer_overflow": "resource_limit",
    "input_changed": "input_changed",
    "cancelled": "cancelled",
    "output_exists": "job_conflict",
    "invalid_path_encoding": "internal",
    "dependency_cycle": "internal",
    "dependency_depth_exceeded": "internal",
    "candidate_exceeded_incumbent": "internal",
    "io": "internal",
}

"""Configuration of a store. Only knobs that act are here; physical format, caches and Bloom filters are Spark's and Parquet's."""

from __future__ import annotations

from dataclasses import dataclass, field

from tidemark.errors import ConfigError
from tidemark.operators.compaction import LevelPolicy

STRATEGIES = ("leveled", "size_tiered", "time_windowed", "hybrid")
#: Longest batch that one call of batch_put takes from the driver; data frames have no such bound.
MAX_BATCH = 10_000


@dataclass(frozen=True)
class Config:
    levels: LevelPolicy = field(default_factory=LevelPolicy)
    strategy: str = "leveled"
    max_batch_size: int = MAX_BATCH
    #: Pending rows on the driver after which a write flushes by itself.
    flush_rows: int = 10_000
    auto_compact: bool = False
    allow_missing_runs: bool = False
    retained_versions: int = 10
    #: Age at which ``vacuum`` takes a folder that no manifest ever named for what a dead job left, not for a write on its way.
    orphan_seconds: int = 86_400
    #: Whether compaction follows the workload (``KvStore.update_workload_characteristics``) in place of ``strategy``.
    adaptive: bool = False

    def problems(self) -> list[str]:
        """All that is wrong, in the order of the fields."""
        found = []
        if self.levels.target_size < 1024:
            found.append("levels.target_size should be at least 1KB")
        if not 0 < self.levels.levels <= 20:
            found.append("levels.levels must be from 1 to 20")
        if self.levels.multiplier <= 1.0:
            found.append("levels.multiplier must be greater than 1.0")
        if self.levels.max_l0_files < 1:
            found.append("levels.max_l0_files must be greater than 0")
        if self.strategy not in STRATEGIES:
            found.append(f"strategy must be one of {', '.join(STRATEGIES)}")
        if self.max_batch_size < 1:
            found.append("max_batch_size must be greater than 0")
        if self.flush_rows < 1:
            found.append("flush_rows must be greater than 0")
        if self.retained_versions < 1:
            found.append("retained_versions must be greater than 0")
        if self.orphan_seconds < 0:
            found.append("orphan_seconds must not be negative")
        return found

    def validate(self) -> Config:
        found = self.problems()
        if found:
            raise ConfigError("Configuration validation failed:\n" + "\n".join(found))
        return self

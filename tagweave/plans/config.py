"""Settings of the jobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EnrichConfig:
    """Model access (read by `client.http_client`) and prompt limits; temperature is held in [0, 1].

    `concurrency` calls of one task run at once, so a job has at most that times its running tasks in flight.
    """

    base_url: str = ""
    model: str = ""
    temperature: float = 0.2
    max_lines: int = 200
    max_chars: int = 12000
    max_tokens: int = 96
    timeout: float = 60.0
    concurrency: int = 4
    retries: int = 2
    pause: float = 0.5  # seconds before the first new try, doubled for each next one

    def clamped_temperature(self) -> float:
        return min(1.0, max(0.0, self.temperature))


@dataclass(frozen=True)
class BuildConfig:
    extra_ignore: tuple[str, ...] = ()
    min_cluster: int = 3
    cluster_by_path_from: int = 300
    batch_size: int = 100
    #: Also write the index as one JSON document, which passes the driver whole; for small trees and tools that read it.
    export_json: bool = False
    enrich: EnrichConfig = EnrichConfig()

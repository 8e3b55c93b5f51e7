"""Settings, from the environment where it names them."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


def _default(name: str, value: object) -> object:
    return field(default_factory=lambda: type(value)(os.environ.get(name.upper(), value)))


@dataclass(frozen=True)
class Settings:
    bootstrap_servers: str = _default("bootstrap_servers", "localhost:9092")
    topic: str = _default("topic", "user-events")
    consumer_group: str = _default("consumer_group", "feature-pipeline")
    offline_path: str = _default("offline_path", "feature_store/offline")
    online_path: str = _default("online_path", "feature_store/online")
    checkpoint_path: str = _default("checkpoint_path", "feature_store/checkpoints")
    default_ttl_seconds: int = _default("default_ttl_seconds", 86400)
    n_users: int = _default("n_users", 10_000)
    n_items: int = _default("n_items", 5_000)
    events_per_second: int = _default("events_per_second", 100)
    batch_size: int = _default("batch_size", 100)

    def as_dict(self) -> dict[str, object]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

"""Engine options. Each can be switched without changing any query's answer."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Mode(Enum):
    """Where scans get their columns and who filters them."""

    PULL_UP = "pull_up"
    PUSHDOWN_ONLY = "pushdown_only"
    CACHING_ONLY = "caching_only"
    HYBRID = "hybrid"
    ADAPTIVE = "adaptive"


class Prefilter(Enum):
    NONE = "none"
    #: Bloom filters from the smaller to the larger side of each join.
    JOIN = "join"
    #: Bloom filters over the whole join graph, there and back.
    BLOOM = "bloom"
    #: Exact key sets over the whole join graph, there and back.
    SEMI = "semi"


class TransferOrder(Enum):
    SMALL_TO_LARGE = "small_to_large"
    BREADTH_FIRST = "breadth_first"


@dataclass(frozen=True)
class StoreLoad:
    """What the adaptive mode knows of the store: how long a request waits, how many were refused, how many pull-ups run at once."""

    wait_seconds: float = 0.0
    fallbacks: int = 0
    max_pullups: int = 36


@dataclass(frozen=True)
class EngineConfig:
    mode: Mode = Mode.PUSHDOWN_ONLY
    cache_policy: str = "lru"
    cache_bytes: int = 1 << 30
    prefilter: Prefilter = Prefilter.NONE
    transfer_order: TransferOrder = TransferOrder.SMALL_TO_LARGE
    bloom_rate: float = 0.01
    bloom_max_rows: int = 20_000_000
    zone_maps: bool = True
    store: StoreLoad = StoreLoad()

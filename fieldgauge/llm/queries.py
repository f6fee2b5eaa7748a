"""All registered queries of this subpackage."""

from fieldgauge.llm import (chat, exact_dedup, katz, kmeans_dedup, lookup_kmeans, mixing, packing, pii, prefix_trie,  # noqa: F401
                            secrets, sharding, simhash, toxicity)
from fieldgauge.llm.common import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]

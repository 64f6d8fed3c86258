"""Production parameters that queries and pipeline share."""

from tickloom.llm.mixing import Targets
from tickloom.llm.sharding import HashTree

SHARD_TREE = HashTree.regular(regions=3, racks=2, shards=4)
MIX_TARGETS: Targets = {
    "source": {f"src{k}": 0.05 for k in range(20)},
    "lang": {"en": 0.55, "fr": 0.18, "de": 0.15, "es": 0.12},
    "topic": {"table": 0.02, "shout": 0.01, "symbols": 0.01, "note": 0.06, "article": 0.6, "book": 0.3},
}
MIX_RATE = 0.8

"""All corpus queries; importing the operators registers them."""

from . import (  # noqa: F401
    covertree, cuckoo, decontaminate, jaccard, licenses, packing, ppm, quality, sharding, sitetree, topk, toxicity,
    variants,
)
from .registry import ORACLES, QUERIES  # noqa: F401

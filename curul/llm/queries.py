"""The registered queries of the training-data operators, in the operators' order."""

from curul.llm import decontamination, fingerprints, licenses, line_dedup, near_dedup, packing, personal, prefix_trie, secrets, toxicity, warc, whitening, wrappers  # noqa: F401
from curul.llm.common import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]

"""Imports every operator of this subpackage, which registers its query."""

from groundweave.llm import balltree, decontaminate, htmltext, infill, langid, lexical, minhash, packing, pieces, sharding, substrings, tokenbin, toxicity  # noqa: F401
from groundweave.llm.registry import ORACLES, QUERIES  # noqa: F401

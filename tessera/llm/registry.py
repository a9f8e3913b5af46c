"""The queries of this subpackage and their oracle SQL, by name."""

from __future__ import annotations

from tessera.llm import flac, langid, licenses, nbest, ngram_join, packing, pii, quality, sharding, substrings
from tessera.llm.oracles import ORACLES

QUERIES = {"op1_flac": flac.query, "op2_substrings": substrings.query, "op3_nbest": nbest.query, "op4_ngram_join": ngram_join.query, "op5_quality": quality.query, "op6_licenses": licenses.query, "op7_pii": pii.query, "op8_langid": langid.query, "op9_sharding": sharding.query, "op10_packing": packing.query}

__all__ = ["ORACLES", "QUERIES"]

"""All queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from hustings.llm import bpe, hilbert, hmm, html, jaccard, licences, ordinal, packing, periodic, quality, repeats, trie, warc

MODULES = (bpe, jaccard, quality, html, warc, ordinal, hmm, packing, licences, hilbert, periodic, trie, repeats)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}

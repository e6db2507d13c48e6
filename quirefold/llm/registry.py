"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quirefold.llm import bpe, chat, flac, jaccard, language, licenses, mixing, quality, sufdedup, urls

_MODULES = (bpe, chat, quality, language, mixing, flac, jaccard, urls, licenses, sufdedup)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}

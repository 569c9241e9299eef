"""All queries of the engine's own operators."""

from . import audits, corpus, evaluation, layout, pages, retrieval, revision, streams, strings
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "audits", "corpus", "evaluation", "layout", "pages", "retrieval", "revision", "streams", "strings"]

"""Registered queries."""

from vacantia.plans import answer_queries, crawl_queries, io_queries, page_queries, privacy_queries, search_queries, text_queries  # noqa: F401
from vacantia.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]

"""The queries over the relational and document tables, and their SQL."""

from quillspark.functions import nested, strings, text, values
from quillspark.operators import aggregates, graph, matching, relational, windows
from quillspark.plans import bids, checks, duplicates, evidence, extraction, papers, pricing, requirements, reviews
from quillspark.plans.registry import ORACLE_SQL, QUERIES
from quillspark.sources import html, pdf, tables
from quillspark.streaming import ingest, tasks

FLAGSHIP = "dup_pairs"
PARTS = (nested, strings, text, values, aggregates, graph, matching, relational, windows, duplicates, checks, evidence, extraction, requirements, reviews, bids, pricing, papers, html, pdf, tables, ingest, tasks)

__all__ = ["FLAGSHIP", "ORACLE_SQL", "PARTS", "QUERIES"]

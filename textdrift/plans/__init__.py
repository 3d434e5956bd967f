"""Registered query plans; importing this package fills the registry."""

from textdrift.plans import (analysis_queries, corpus_queries, monitor_queries,  # noqa: F401
                             overlap_queries, pathmodel_queries, text_queries)

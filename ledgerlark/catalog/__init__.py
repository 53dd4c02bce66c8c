"""Registered queries over the driver tables, most with an equivalent SQL text."""

from ledgerlark.catalog import (
    encoding_queries,
    flagship as flagship_queries,
    history_queries,
    metric_queries,
    model_queries,
    ordered_queries,
    profile_queries,
    request_queries,
    row_queries,
    split_queries,
    stream_queries,
)

FAMILIES = (
    flagship_queries, history_queries, row_queries, profile_queries, split_queries, metric_queries, encoding_queries,
    ordered_queries, request_queries, stream_queries, model_queries,
)
flagship = flagship_queries.budget_report

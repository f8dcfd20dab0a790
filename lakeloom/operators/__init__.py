"""DataFrame operators; retrieval operators are keyed by query_id and answer whole batches of queries."""

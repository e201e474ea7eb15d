"""DataFrame operators: filters, joins, aggregates, retrieval, pipeline steps, exports."""

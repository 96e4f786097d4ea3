"""DataFrame-level operators: filters, projections, grouping, sets, windows, search, diff."""

"""DataFrame operators: joins, aggregates, rankings, features, assignment, registry."""

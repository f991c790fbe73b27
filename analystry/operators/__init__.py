"""DataFrame operators: columns, global order, statistics, joins, text features, models."""

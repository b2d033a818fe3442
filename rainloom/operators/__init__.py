"""Series operators: calendar, quality, roll-up, features, joins, splits, models, metrics."""

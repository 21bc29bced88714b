"""DataFrame operators: key handling, scorers, expansions, joins and batch calls."""

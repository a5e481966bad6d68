"""Panel operators: factors, joins, selection, portfolios, execution, evaluation, books."""

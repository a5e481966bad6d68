"""Panel analytics on Spark: factors, portfolios, simulation and evaluation over (date, code) tables."""

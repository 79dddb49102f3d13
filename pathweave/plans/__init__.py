"""Query plans: registered queries over the summary tables."""

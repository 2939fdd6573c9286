"""Query plans: estimates, selection, reports and the registered queries."""

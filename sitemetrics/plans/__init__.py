"""Analytical plans: periods, comparison, reconciliation, allocation, reports, inference."""

"""Scenario specifications, planning, and the registered queries."""

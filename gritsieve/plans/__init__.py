"""Whole queries: mining, batch runs, reports and the bindings to the test tables."""

"""Test and benchmark workload: message feeds made from the given tables, queries over them, expected results."""

"""Inspection and upkeep: info, verify, repair, history, output formats."""

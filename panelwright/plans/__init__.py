"""Registered queries: every operator on the driver tables, with its SQL twin."""

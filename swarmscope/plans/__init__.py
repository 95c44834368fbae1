"""Registered queries: operators over the driver's tables, with their SQL."""

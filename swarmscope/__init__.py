"""Dispersed-phase image analytics and bulk table processing, expressed as PySpark DataFrame plans."""

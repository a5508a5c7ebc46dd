"""Readers for tables and message logs."""

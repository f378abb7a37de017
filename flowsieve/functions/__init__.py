"""Column macros: plain functions from Column to Column."""

"""Stored intermediate tables and the staged run over them."""

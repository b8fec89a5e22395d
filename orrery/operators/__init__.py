"""Operators on tables: DML and column aggregates."""

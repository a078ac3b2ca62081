"""Whole programs over tables, made of the package's functions and operators."""

from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

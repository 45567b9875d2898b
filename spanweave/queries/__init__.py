"""Registered queries: each module has QUERIES, key -> (query, DuckDB SQL or None)."""

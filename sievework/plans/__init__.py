"""Whole pipelines, the registered queries and their DuckDB SQL."""

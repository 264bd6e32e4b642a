"""SQL that Spark and DuckDB both run: table names and the few functions that differ."""

from __future__ import annotations

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark"]


class Duck:
    """DuckDB, tables registered as views."""

    def t(self, table: str) -> str:
        return table

    def sha128(self, expr: str) -> str:
        return f"substr(sha256({expr}), 1, 32)"

    def sub(self, expr: str, pattern: str, to: str) -> str:
        return f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"

    def key(self, expr: str) -> str:
        return self.sub(self.sub(f"lower({expr})", "[^a-z0-9]+", "-"), "^-+|-+$", "")


class Spark(Duck):
    """Spark SQL, tables read from a folder of Parquet files."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def t(self, table: str) -> str:
        return f"parquet.`{self.folder}/{table}.parquet`"

    def sha128(self, expr: str) -> str:
        return f"substr(sha2({expr}, 256), 1, 32)"

    def sub(self, expr: str, pattern: str, to: str) -> str:
        return f"regexp_replace({expr}, '{pattern}', '{to}')"

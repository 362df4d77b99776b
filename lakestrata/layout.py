"""Where layers, schemas, tables and checkpoints live."""

from __future__ import annotations

from dataclasses import dataclass

RAW, BRONZE, SILVER, GOLD = "raw", "bronze", "silver", "gold"


@dataclass(frozen=True)
class Layout:
    """Path and view names of a lakehouse.

    The default keeps every layer under one root. With one bucket per layer, pass for example
    ``pattern="s3a://{layer}/{schema}/{table}"``.
    """

    root: str = ""
    pattern: str = "{root}/{layer}/{schema}/{table}"

    def path(self, layer: str, schema: str, table: str) -> str:
        return self.pattern.format(
            root=self.root.rstrip("/"), layer=layer, schema=schema, table=table
        )

    def checkpoint(self, schema: str, table: str) -> str:
        return self.path("checkpoints", schema, f"{table}_checkpoint")

    @staticmethod
    def view(schema: str, table: str) -> str:
        """Name under which SQL files read a table of the layer below them."""
        return f"{schema}_{table}"

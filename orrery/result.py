"""What a statement gives back."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass
class QueryResult:
    """Columns and rows (collected when first asked for), a message, and whether it worked."""

    columns: list[str] = field(default_factory=list)
    message: str = ""
    success: bool = True
    frame: DataFrame | None = field(default=None, repr=False)
    statement: str = ""
    _rows: list[dict[str, Any]] | None = field(default=None, repr=False)

    @property
    def rows(self) -> list[dict[str, Any]]:
        if self._rows is None:
            self._rows = [dict(zip(self.columns, r)) for r in self.frame.collect()] if self.frame is not None else []
        return self._rows

    @property
    def row_count(self) -> int:
        return len(self.rows)

    def render(self) -> str:
        """A padded table, NULL for nulls, and the number of rows."""
        if not self.success:
            return self.message
        if not self.columns:
            return self.message
        cells = [[("NULL" if v is None else str(v)) for v in r.values()] for r in self.rows]
        width = [max(len(c), *(len(r[i]) for r in cells)) if cells else len(c) for i, c in enumerate(self.columns)]
        line = lambda r: " | ".join(x.ljust(w) for x, w in zip(r, width)).rstrip()
        return "\n".join([line(self.columns), "-+-".join("-" * w for w in width), *map(line, cells), f"({len(cells)} row(s) returned)"])

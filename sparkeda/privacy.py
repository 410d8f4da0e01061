"""What a language model may see of a dataset."""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass, field


@dataclass(frozen=True)
class PrivacyPolicy:
    """columns: action per column ('allow', 'redact', 'alias', 'exclude'), else `default`. Values stay here unless share_values."""

    default: str = "allow"
    columns: dict[str, str] = field(default_factory=dict)
    share_values: bool = False
    secret: bytes = b"sparkeda"

    def action(self, column: str) -> str:
        return self.columns.get(column, self.default)

    def safe_name(self, column: str) -> str | None:
        """The name to show; None leaves the column out."""
        action = self.action(column)
        if action == "exclude":
            return None
        if action == "redact":
            return "[redacted]"
        if action == "alias":
            return "column_" + hmac.new(self.secret, column.encode(), hashlib.sha256).hexdigest()[:10]
        return column

    def describe(self, column: str, facts: dict) -> dict | None:
        name = self.safe_name(column)
        if name is None:
            return None
        hidden = set() if self.share_values and self.action(column) == "allow" else {"top_values", "min", "max", "examples"}
        return {"column": name} | {k: v for k, v in facts.items() if k not in hidden | {"column"}}

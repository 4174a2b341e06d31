"""Tables written to the shared folder, to be read more than once or to cut a long plan."""

from __future__ import annotations

from ..session import narrowed, stored

__all__ = ["narrowed", "stored"]

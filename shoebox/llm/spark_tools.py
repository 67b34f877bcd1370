"""What the operators need of the session: shipped code, saved tables, components."""

from __future__ import annotations

from ..operators.components import components
from ..operators.ranks import numbered_within
from ..session import forget, saved, shared_folder, ship

__all__ = ["components", "forget", "numbered_within", "saved", "shared_folder", "ship"]

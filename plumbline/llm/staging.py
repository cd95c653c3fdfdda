"""Staged tables, as the rest of the library keeps them."""

from plumbline.sources.staging import Workspace, shared_root

__all__ = ["Workspace", "shared_root"]

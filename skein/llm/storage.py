"""Intermediate tables, as ``skein.operators.storage`` keeps them."""

from skein.operators.storage import materialise, shared_dir

__all__ = ["materialise", "shared_dir"]

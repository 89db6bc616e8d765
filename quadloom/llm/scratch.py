"""Arrow batches and intermediate tables of the corpus operators."""

from __future__ import annotations

from quadloom.scratch import Scratch, shared_dir
from quadloom.scratch import bounded_batches as tune

__all__ = ["Scratch", "shared_dir", "tune"]

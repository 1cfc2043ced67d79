"""What the operators take from the session: the shared folder and the number of shuffle partitions."""

from __future__ import annotations

from logweave.shared import delete, new_folder, partitions, scratch, shared_folder, stored

__all__ = ["delete", "new_folder", "partitions", "scratch", "shared_folder", "stored"]

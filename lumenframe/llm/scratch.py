"""Tables and files that several stages share; see ``lumenframe.storage``."""

from lumenframe.storage import new_path, partitions, shared_dir, table

__all__ = ["new_path", "partitions", "shared_dir", "table"]

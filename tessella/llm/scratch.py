"""Intermediate tables: the library's."""

from tessella.sources.stored import SETTING, new_path, remove, root, written

__all__ = ["SETTING", "new_path", "remove", "root", "written"]

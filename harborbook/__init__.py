"""Specialty-insurance analytics as PySpark DataFrame operators and ready-made marts."""

from harborbook.config import MartConfig

__all__ = ["MartConfig"]

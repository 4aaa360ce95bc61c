"""Where tables come from and go to."""

from querywright.sources.catalog import Catalog

__all__ = ["Catalog"]

from profilebook.sources.catalog import Catalog

__all__ = ["Catalog"]

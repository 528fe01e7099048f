from lekhya.sources.tables import table

__all__ = ["table"]

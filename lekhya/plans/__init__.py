from lekhya.plans.lineage import cut, shared_folder
from lekhya.plans.positions import positions

__all__ = ["cut", "positions", "shared_folder"]

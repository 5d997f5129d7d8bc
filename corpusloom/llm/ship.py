"""The package on the executors' path; see ``corpusloom.ship``."""

from corpusloom.ship import ship

__all__ = ["ship"]

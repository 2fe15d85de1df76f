from lodestream.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

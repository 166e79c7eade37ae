"""The registered queries: each pairs a DataFrame plan with an independent SQL statement."""

from quire.plans.registry import oracles, registered

__all__ = ["oracles", "registered"]

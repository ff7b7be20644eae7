"""Reader-cohort analytics over user x item rating graphs, planned by Catalyst."""

__version__ = "0.1.0"

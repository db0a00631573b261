"""veilframe: private synthetic data and its evaluation, expressed as Spark plans."""

__version__ = "0.1.0"

"""adwatch: Spark jobs that turn crawled classified ads into a ranked, reported, auditable investigation queue."""

__version__ = "0.1.0"

"""ledgerwalk — file-catalogue analytics as Spark table jobs.

Packages: ``functions`` (native Column expressions), ``operators`` (table
jobs), ``sources`` (listing, table versions, file bytes, extractor JSON),
``plans`` (catalogues derived from the driver tables and the registered
queries), ``streaming`` (incremental drivers).
"""

__version__ = "0.1.0"

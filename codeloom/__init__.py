"""Spark jobs that turn crawled pages, chat logs and dumps into a queryable corpus of source files.

Layout
------
``rules``      fixed values: site rules, language tables, name fingerprints, manifest texts
``functions``  Column -> Column building blocks (native expressions only)
``operators``  DataFrame -> DataFrame jobs
``sources``    readers, canonical views over the driver's tables, snapshot and project sinks
``streaming``  Structured Streaming forms of the live jobs
``plans``      the registered queries with their SQL counterparts
"""

__version__ = "0.1.0"

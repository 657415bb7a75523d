"""tidemark: reconcile file collections and search text corpora with Spark DataFrames.

Every operator is a plain function from DataFrames (or Columns) to DataFrames (or
Columns); Catalyst plans the work. Sub-packages:

* ``functions`` - Column -> Column expressions (checksums, paths, sizes, text, probes).
* ``sources``   - readers for listings, inventories, catalogs, corpora, configs and the
                  test fixtures bound to the driver tables.
* ``operators`` - table updates, joins, orderings, aggregates, integrity checks,
                  retrieval and the optional recognition-table operators.
* ``plans``     - the user-level jobs (sync planning, audit, diagnostics, validation,
                  index build, search).
* ``streaming`` - Structured Streaming forms of discovery, change detection, staleness
                  and incremental indexing.
"""

__version__ = "0.1.0"

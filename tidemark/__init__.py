"""tidemark — text-to-signal analytics as Spark DataFrame jobs.

Every public operator takes DataFrames (plus plain parameters) and returns a
lazy DataFrame; nothing is collected to the driver.  Sub-packages:

* ``functions``  – Column-level helpers (text, vectors, encoder, scorer, fixed values)
* ``sources``    – readers and writers (Parquet, text corpora, index files, upserts)
* ``operators``  – prices, filings, news, sentiment, aspects, embeddings, novelty,
                   features, statistics and models
* ``plans``      – the registered query catalogue and its DuckDB oracle SQL
* ``streaming``  – Structured Streaming twins of the incremental operators
"""

from tidemark.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]

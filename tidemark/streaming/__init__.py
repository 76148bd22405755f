"""Structured Streaming twins (dedupe, file-source filings, stateful novelty,
tumbling-day sentiment, idempotent upsert)."""

from tidemark.streaming.twins import (dedupe_batch_writer, first_article_writer, read_if_there, stream_daily_sentiment,
                                      stream_dedupe_news, stream_dedupe_store, stream_filings, stream_first_articles,
                                      stream_novelty_final, stream_upsert, stream_upsert_versions, upsert_batch_writer)

__all__ = ["dedupe_batch_writer", "first_article_writer", "read_if_there", "stream_daily_sentiment",
           "stream_dedupe_news", "stream_dedupe_store", "stream_filings", "stream_first_articles",
           "stream_novelty_final", "stream_upsert", "stream_upsert_versions", "upsert_batch_writer"]

"""Corpus preparation operators: tokens, shards, chat text, deduplication, quality, search, mixing."""

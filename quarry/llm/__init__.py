"""Training-data operators (language-model scoring, deduplication, filtering, tokenising...)."""

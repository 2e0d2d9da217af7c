"""Operators for text corpora that train language models: scoring, filtering,
deduplication, tokenizing, decontamination. Nothing else in the library imports
this subpackage."""

"""Operators for training-data pipelines: secrets, near and exact duplicates, HTML text,
source mixing, toxicity, quality, content-addressed archives, personal data and
benchmark decontamination.

Nothing else in the library imports this subpackage; its queries are registered in
``llm.queries`` and added by ``__spark_entry__`` when the subpackage is present."""

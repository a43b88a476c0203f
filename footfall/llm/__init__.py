"""Operators of a training-data pipeline: near copies, packing, token counts, languages,
benchmark leaks, licences, archives, page text, chat formatting and vector search."""

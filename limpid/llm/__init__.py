"""Operators for training corpora: archives, tokenizers, near duplicates, language models, filters, packing."""

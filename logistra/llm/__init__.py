"""Operators for the text corpus of a language model's training run."""

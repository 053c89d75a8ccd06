"""The query modules of this subpackage."""

from tidemark.llm import basics, mixes, pages, texts, vectors

MODULES = [basics, vectors, texts, pages, mixes]

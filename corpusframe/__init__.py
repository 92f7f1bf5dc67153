"""corpusframe: document-corpus retrieval and analytics as Spark DataFrame operators."""

from corpusframe.config import Config

__all__ = ["Config"]

"""Contracts of what can be exchanged: loaders, chunkers, models and stores of vectors. Any callable or object of that form will do."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame


class Loader(Protocol):
    """Reads files (path, content) of one kind: (path, title, author, contents, documents, error), a broken file with an error and nulls."""

    def __call__(self, files: DataFrame) -> DataFrame: ...


class Chunker(Protocol):
    """Cuts sections (section_id, raw_text, ...) into chunks with the columns of :func:`folio.operators.chunk.chunks`."""

    def __call__(self, sections: DataFrame) -> DataFrame: ...


class Completion(Protocol):
    """Answers a system and a user message with a text; an exception is a failed call."""

    def __call__(self, system: str, user: str) -> str: ...


class Embedding(Protocol):
    """Gives a vector for each of some texts, in their order."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class VectorStore(Protocol):
    """Keeps chunks with vectors by book."""

    def append(self, chunks: DataFrame) -> None: ...

    def read(self, book_id: str | None = None, section_id: str | None = None) -> DataFrame: ...

    def search(self, query: list[float], where: Column | None = None, k: int = 5) -> DataFrame: ...

    def delete(self, book_id: str) -> bool: ...

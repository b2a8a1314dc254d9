"""What a part must offer to be plugged in: DataFrames in, DataFrames out."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


class Reranker(Protocol):
    """Ranked candidates (query, document, score, rank) to the best k of them."""

    def rerank(self, questions: DataFrame, candidates: DataFrame, k: int) -> DataFrame: ...


class StructuredStore(Protocol):
    def lookup(self, subjects: DataFrame, field: str) -> DataFrame: ...


class SemanticStore(Protocol):
    def search(self, questions: DataFrame, k: int) -> DataFrame: ...


class FormulaStore(Protocol):
    def find(self, questions: DataFrame, k: int) -> DataFrame: ...


class ProvenanceResolver(Protocol):
    def provenance(self, facts: DataFrame) -> DataFrame: ...


class ExtractionAdapter(Protocol):
    """Raw extractions (key, body) to cells."""

    def cells(self, raw: DataFrame, key: str, body: str) -> DataFrame: ...


class RepairProvider(Protocol):
    """Proposed repairs of texts; functions.text.validate_repair judges them."""

    def propose(self, texts: DataFrame) -> DataFrame: ...


class SchemaRegistry:
    """Schemas by name, the rules of their fields, and the names that headers may have."""

    def __init__(self) -> None:
        self.schemas: dict[str, T.StructType] = {}
        self.rules: dict[str, dict[str, Column]] = {}
        self.aliases: dict[str, dict[str, str]] = {}

    def register(self, name: str, schema: T.StructType, rules: dict[str, Column] | None = None, aliases: dict[str, str] | None = None) -> None:
        self.schemas[name], self.rules[name], self.aliases[name] = schema, rules or {}, {k.lower(): v for k, v in (aliases or {}).items()}

    def field_of(self, name: str, header: str) -> str | None:
        return self.aliases[name].get(" ".join(header.lower().split()))

    def issues(self, name: str) -> Column:
        """Names of the rules that a row breaks."""
        from ..operators.quality import issue_list

        return issue_list(self.rules[name])


class HeadReranker:
    def rerank(self, questions: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
        from ..operators.fusion import head

        return head(candidates, k)


class LexicalReranker:
    """Questions (query, question) and documents (document, text)."""

    def __init__(self, documents: DataFrame):
        self.documents = documents

    def rerank(self, questions: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
        from ..operators.fusion import lexical_rerank

        return lexical_rerank(candidates.join(self.documents, "document").join(questions, "query"), "question", "text", k)

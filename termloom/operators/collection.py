"""A document collection with its indexes, each built once and kept while the collection lives."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from . import boolean, index, phrase, tolerant, wildcard
from .preprocess import PreprocessConfig


class Collection:
    """Documents (doc_id, text[, doc_ord]) under one configuration. Indexes are persisted when first used; ``clear`` lets them go."""

    def __init__(self, docs: DataFrame, cfg: PreprocessConfig = PreprocessConfig(), k: int = 3):
        self.docs, self.cfg, self.k = docs, cfg, k
        self._kept: list[DataFrame] = []

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist())
        return self._kept[-1]

    @cached_property
    def postings(self) -> DataFrame:
        return self._keep(index.build_inverted_index(self.docs, self.cfg))

    @cached_property
    def vocabulary(self) -> DataFrame:
        return self._keep(self.postings.select("term").distinct())

    @cached_property
    def biwords(self) -> DataFrame:
        return self._keep(index.build_biword_index(self.docs))

    @cached_property
    def positions(self) -> DataFrame:
        return self._keep(index.build_positions(self.docs))

    @cached_property
    def kgrams(self) -> DataFrame:
        return self._keep(index.build_kgram_index(self.vocabulary, self.k))

    @cached_property
    def soundex(self) -> DataFrame:
        return self._keep(index.build_phonetic_index(self.vocabulary, "soundex"))

    @cached_property
    def metaphone(self) -> DataFrame:
        return self._keep(index.build_phonetic_index(self.vocabulary, "metaphone"))

    def boolean(self, query: str, normalize_query: bool = False) -> DataFrame:
        """Documents of a boolean query; normalize_query stems its terms as the index's."""
        return boolean.boolean_query(boolean.normalized(query, self.cfg) if normalize_query else query, self.postings, self.docs)

    def phrase(self, query: str) -> DataFrame:
        return phrase.query_positional(query, self.positions)

    def compare_phrase(self, query: str, compat: str = "documented") -> DataFrame:
        return phrase.compare_indexes(query, self.docs, self.biwords, self.positions, compat)

    def wildcard(self, pattern: str, compat: str = "documented") -> DataFrame:
        return wildcard.query_wildcard(pattern.lower().strip(), self.kgrams, self.vocabulary, self.k, compat)

    def tolerant(self, query: str, max_dist: int = 2) -> tolerant.TolerantResult:
        return tolerant.tolerant_search(query, self.postings, self.vocabulary, self.kgrams, self.soundex, self.metaphone, self.k, max_dist)

    def clear(self) -> None:
        for df in self._kept:
            df.unpersist()
        self._kept.clear()
        for name in ("postings", "vocabulary", "biwords", "positions", "kgrams", "soundex", "metaphone"):
            self.__dict__.pop(name, None)

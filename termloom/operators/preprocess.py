"""The preprocessing pipeline: one row a document, one column a stage. No stage but a lemmatizer with a lexicon moves rows."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..functions.stemming import porter, snowball
from . import lemmas


@dataclass(frozen=True)
class PreprocessConfig:
    """Options of the pipeline. tokenizer: ``simple`` or ``treebank``; stemmer: ``porter``, any other name means the second algorithm."""

    lowercase: bool = True
    handle_hyph: bool = True
    rm_stopwords: bool = True
    do_stem: bool = False
    do_lemma: bool = False
    stemmer: str = "porter"
    tokenizer: str = "simple"
    extra_stopwords: tuple[str, ...] = ()

    def but(self, **changes) -> PreprocessConfig:
        return replace(self, **changes)


@F.pandas_udf(ArrayType(StringType()))
def _porter_all(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: None if ts is None else [porter(t) for t in ts])


@F.pandas_udf(ArrayType(StringType()))
def _snowball_all(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: None if ts is None else [snowball(t) for t in ts])


def stem_tokens(tokens: Column, stemmer: str = "porter") -> Column:
    """The stems of an array of tokens, in Arrow batches; a worker stems each distinct token once."""
    return (_porter_all if stemmer == "porter" else _snowball_all)(tokens)


def changed_map(tokens: Column, forms: Column) -> Column:
    """Map from each changed token to its form."""
    pairs = F.filter(F.arrays_zip(tokens.alias("t"), forms.alias("f")), lambda p: p["t"] != p["f"])
    return F.map_from_entries(F.array_distinct(F.transform(pairs, lambda p: F.struct(p["t"], p["f"]))))


def preprocess(docs: DataFrame, cfg: PreprocessConfig = PreprocessConfig(), lexicon: DataFrame | None = None) -> DataFrame:
    """``docs`` (doc_id, text) with raw_tokens, lower_tokens, hyph_tokens, clean_tokens, removed_sw, final_tokens, stem_map and lemma_map.

    Order: tokenize, lower-case, expand hyphens, keep words, remove stop words, then
    lemmatize and stem as asked; with both, stems are of lemmas, and so are the keys
    of stem_map. A null text counts as empty. ``lexicon`` (term) is what lemmas are
    looked up in (see ``lemmas``); without it they come from rules. Columns of ``docs`` of the
    stages' names are replaced.
    """
    tokenize = T.treebank_tokenize if cfg.tokenizer == "treebank" else T.simple_tokenize
    col = F.col
    out = docs.withColumn("raw_tokens", tokenize(col("text")))
    if cfg.lowercase:
        lower = tokenize(F.lower("text")) if cfg.tokenizer == "simple" else T.to_lowercase(col("raw_tokens"))
    out = out.withColumn("lower_tokens", lower if cfg.lowercase else col("raw_tokens"))
    out = out.withColumn("hyph_tokens", T.handle_hyphen(col("lower_tokens")) if cfg.handle_hyph else col("lower_tokens"))
    out = out.withColumn("clean_tokens", T.keep_wordlike(col("hyph_tokens")))
    none = F.array().cast("array<string>")
    kept, removed = T.remove_stopwords(col("clean_tokens"), cfg.extra_stopwords)
    out = out.withColumn("removed_sw", removed if cfg.rm_stopwords else none).withColumn("final_tokens", kept if cfg.rm_stopwords else col("clean_tokens"))
    no_map = F.create_map().cast("map<string,string>")
    out = out.withColumn("stem_map", no_map).withColumn("lemma_map", no_map)
    if cfg.do_lemma:
        out = lemmas.lemmatized(out, lexicon)
        out = out.withColumn("lemma_map", changed_map(col("final_tokens"), col("lemma_tokens"))).withColumn("final_tokens", col("lemma_tokens")).drop("lemma_tokens")
    if cfg.do_stem:
        out = out.withColumn("stem_tokens", stem_tokens(col("final_tokens"), cfg.stemmer))
        out = out.withColumn("stem_map", changed_map(col("final_tokens"), col("stem_tokens"))).withColumn("final_tokens", col("stem_tokens")).drop("stem_tokens")
    return out


def final_tokens(docs: DataFrame, cfg: PreprocessConfig = PreprocessConfig(), lexicon: DataFrame | None = None) -> DataFrame:
    """doc_id and final_tokens, with doc_ord where ``docs`` has it."""
    keep = ["doc_id", *(c for c in ("doc_ord",) if c in docs.columns)]
    return preprocess(docs.select(*keep, "text"), cfg, lexicon).select(*keep, "final_tokens")


def unnested(df: DataFrame, array: Column, pos: str | None, item: str, *keep: str) -> DataFrame:
    """A row for each item of an array, with its place under the name ``pos``, and the columns kept.

    The outer form of explode, with its empty rows filtered after: the plain form
    makes the optimizer evaluate a computed array twice, once to filter by its size.
    """
    if pos is None:
        return df.select(*keep, F.explode_outer(array).alias(item)).where(F.col(item).isNotNull())
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())


def exploded(docs: DataFrame, column: str = "final_tokens") -> DataFrame:
    """doc_id, pos (from 0) and token, from an array column."""
    return unnested(docs, F.col(column), "pos", "token", "doc_id")


def phrase_tokens(docs: DataFrame, tokenizer: str = "simple") -> DataFrame:
    """doc_id and tokens as phrase indexes see them: lower-cased words, hyphens kept, nothing removed."""
    lower = T.to_lowercase(T.treebank_tokenize(F.col("text"))) if tokenizer == "treebank" else T.simple_tokenize(F.lower("text"))
    return docs.select("doc_id", T.phrase_words(lower).alias("tokens"))


def timed_preprocess(docs: DataFrame, cfg: PreprocessConfig = PreprocessConfig()) -> tuple[DataFrame, float]:
    """The preprocessed frame and the milliseconds (3 places) that making all its rows once took."""
    out = preprocess(docs, cfg)
    began = time.perf_counter()
    out.write.format("noop").mode("overwrite").save()
    return out, round((time.perf_counter() - began) * 1000, 3)

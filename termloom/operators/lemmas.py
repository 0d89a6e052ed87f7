"""Lemmas: from a lexicon where one is given, else by rules of spelling.

Neither looks at the other words of the collection, so that a document's lemmas don't
depend on its neighbours. With a lexicon (``read_lexicon``: the public WordNet
database files, or a plain list of words) a form counts as a lemma if the lexicon has
it for the part of speech; the listed exceptions come first, then the shortest of the
form itself and what is left of it without an ending. Without one, the first rule of
RULES that fits decides, after a short table of irregular forms; that moves no rows.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Environment variable that names the lexicon which ``default_lexicon`` reads, and where the WordNet database is usually installed.
LEXICON, INSTALLED = "TERMLOOM_LEXICON", ("/usr/share/wordnet", "/usr/share/wordnet/dict", "/usr/local/WordNet-3.0/dict")

#: Endings and what they become, by part of speech.
ENDINGS = {
    "n": (("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"), ("s", "")),
    "v": (("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", ""), ("s", "")),
    "a": (("er", ""), ("est", ""), ("er", "e"), ("est", "e")),
}
#: Irregular forms, by part of speech.
IRREGULAR = {
    "n": {"geese": "goose", "mice": "mouse", "feet": "foot", "teeth": "tooth", "men": "man", "women": "woman", "children": "child", "indices": "index", "analyses": "analysis", "oxen": "ox", "data": "datum", "criteria": "criterion", "phenomena": "phenomenon", "corpora": "corpus", "hypotheses": "hypothesis", "knives": "knife", "lives": "life", "wives": "wife", "shoes": "shoe", "news": "news", "series": "series", "species": "species", "gas": "gas", "lens": "lens"},
    "v": {"was": "be", "were": "be", "is": "be", "are": "be", "been": "be", "am": "be", "has": "have", "had": "have", "did": "do", "does": "do", "done": "do", "went": "go", "gone": "go", "going": "go", "ran": "run", "said": "say", "made": "make", "took": "take", "taken": "take", "found": "find", "wrote": "write", "written": "write", "held": "hold", "fell": "fall", "lost": "lose", "beat": "beat", "rose": "rise", "bound": "bind", "added": "add", "adding": "add", "being": "be", "seeing": "see", "during": "during", "evening": "evening", "morning": "morning"},
    "a": {"better": "good", "best": "good", "worse": "bad", "worst": "bad", "further": "far"},
}
#: Rules in order, by part of speech: a pattern of whole lower-case words and what stands for it; ``$0`` leaves the word as it is.
RULES = {
    "n": (
        (r"(?s)^.*(?:ss|us|is)$", "$0"),
        (r"(?s)^(.{2,})ies$", "$1y"),
        (r"(?s)^(.+(?:ss|zz|sh|ch|x|[^aeiou]o))es$", "$1"),
        (r"(?s)^(.{2,}[^s'])s$", "$1"),
    ),
    "v": (
        (r"(?s)^.*eed$", "$0"),
        (r"(?s)^(.{2,})ied$", "$1y"),
        *((rf"(?s)^(.*[aeiouy]{c}){c}(?:ing|ed)$", "$1") for c in "bdfgmnprt"),
        (r"(?s)^(creat|chang|.*[aeiouy].*[^aeiou]at|.*[aeiouy].*(?:bl|iz|v|c|dg|rg|ang|ag|scrib|lud|par|clar|[^aeiouyq]u|[^aeo]i[dnr]|[^aeo]u[lrt]|[^o]ok))(?:ing|ed)$", "$1e"),
        (r"(?s)^(.*(?:[aeioy]|[^c]u)s)(?:ing|ed)$", "$1e"),
        (r"(?s)^([^aeiouy]*[aeiouy][^aeiouywx])(?:ing|ed)$", "$1e"),
        (r"(?s)^(.*[aeiouy].*)(?:ing|ed)$", "$1"),
    ),
    "a": ((r"(?s)^(.{2,}[aeiou].*)i(?:er|est)$", "$1y"),),
}


def by_rule(token: Column, pos: str = "n") -> Column:
    """The lemma of a token by the irregular forms and rules of a part of speech, as an expression; the token itself where none fits."""
    special = F.create_map(*(F.lit(x) for pair in IRREGULAR[pos].items() for x in pair))
    by = F.lit(None).cast("string")
    for pattern, put in reversed(RULES[pos]):
        by = F.when(token.rlike(pattern), token if put == "$0" else F.regexp_replace(token, pattern, put)).otherwise(by)
    return F.coalesce(special[token], by, token)


def lemma_of(token: Column) -> Column:
    """The noun's lemma, else the verb's, by rule."""
    noun = by_rule(token, "n")
    return F.when(noun != token, noun).otherwise(by_rule(token, "v"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon: pos (n, v, a or null for any), term, and form where the row is an exception, whose lemma is term.

    ``path``: a folder with WordNet's index.noun, noun.exc and so on, or files of a word a line.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    has = lambda name: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(hadoop, name))
    none = F.lit(None).cast("string")
    if not has("index.noun"):
        words = spark.read.text(path).select(F.lower(F.trim("value")).alias("term")).where("term <> ''").distinct()
        return words.select(none.alias("pos"), "term", none.alias("form"))
    parts = []
    for pos, name in (("n", "noun"), ("v", "verb"), ("a", "adj")):
        # lines that begin with a blank are the licence; a word is the first field
        index = spark.read.text(f"{path}/index.{name}").where(~F.col("value").startswith(" "))
        parts.append(index.select(F.lit(pos).alias("pos"), F.split("value", " ")[0].alias("term"), none.alias("form")))
        if has(f"{name}.exc"):
            exc = spark.read.text(f"{path}/{name}.exc").select(F.split(F.trim("value"), " +").alias("f")).where(F.size("f") >= 2)
            parts.append(exc.select(F.lit(pos).alias("pos"), F.col("f")[1].alias("term"), F.col("f")[0].alias("form")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def default_lexicon(spark: SparkSession) -> DataFrame | None:
    """The lexicon named by the environment, else an installed WordNet, else none."""
    named = os.environ.get(LEXICON)
    found = named or next((p for p in INSTALLED if os.path.exists(f"{p}/index.noun")), None)
    return read_lexicon(spark, found if "://" in found or not found.startswith("/") else f"file://{found}") if found else None


def candidates(token: Column, pos: str) -> Column:
    """Array of the forms a token may be inflected from, itself included."""
    forms = [F.when(token.endswith(end) & (F.length(token) > len(end)), F.concat(token.substr(F.lit(1), F.length(token) - len(end)), F.lit(put))) for end, put in ENDINGS[pos]]
    return F.array_distinct(F.filter(F.array(token, *forms), lambda f: f.isNotNull() & (F.length(f) > 0)))


def lemma_table(tokens: DataFrame, pos: str = "n", lexicon: DataFrame | None = None) -> DataFrame:
    """token and lemma of the distinct ``tokens`` (token) whose lemma differs, for a part of speech: n, v or a. Null tokens have none."""
    words = tokens.select("token").where("token is not null").distinct()
    if lexicon is None:
        return words.select("token", by_rule(F.col("token"), pos).alias("lemma")).where("token <> lemma")
    whole = {"pos": F.lit(None).cast("string"), "form": F.lit(None).cast("string")}
    lexicon = lexicon.withColumns({c: v for c, v in whole.items() if c not in lexicon.columns})
    own = lexicon.where(F.col("pos").isNull() | (F.col("pos") == pos))
    known = own.where("form is null").select(F.col("term").alias("lemma")).distinct()
    special = own.where("form is not null").groupBy(F.col("form").alias("token")).agg(F.min(F.struct(F.length("term").alias("n"), F.col("term").alias("lemma"))).alias("s"))
    forms = words.select("token", F.explode(candidates(F.col("token"), pos)).alias("lemma")).join(known, "lemma", "left_semi")
    best = forms.groupBy("token").agg(F.min(F.struct(F.length("lemma").alias("n"), F.col("lemma").alias("lemma"))).alias("best"))
    listed = words.join(special, "token").select("token", "s.lemma")
    return listed.union(best.join(special, "token", "left_anti").select("token", "best.lemma")).where("token <> lemma")


def lemma_or_verb(tokens: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """token and lemma where it differs: the noun's, else the verb's."""
    if lexicon is None:
        words = tokens.select("token").where("token is not null").distinct()
        return words.select("token", lemma_of(F.col("token")).alias("lemma")).where("token <> lemma")
    nouns = lemma_table(tokens, "n", lexicon)
    return nouns.union(lemma_table(tokens.join(nouns.select("token"), "token", "left_anti"), "v", lexicon))


def lemmatized(docs: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """``docs`` with lemma_tokens beside final_tokens.

    By rule no row moves. With a lexicon only changed tokens are joined; documents come
    back by their id and tokens.
    """
    if lexicon is None:
        return docs.withColumn("lemma_tokens", F.transform("final_tokens", lemma_of))
    tokens = docs.select(F.col("doc_id").alias("_id"), F.col("final_tokens").alias("_of"), F.explode("final_tokens").alias("token")).distinct()
    changed = tokens.join(lemma_or_verb(tokens.select("token"), lexicon), "token")
    by_row = changed.groupBy("_id", "_of").agg(F.map_from_entries(F.collect_set(F.struct("token", "lemma"))).alias("_lemmas"))
    joined = docs.join(by_row, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("final_tokens") == F.col("_of")), "left")
    lemma = F.transform("final_tokens", lambda t: F.coalesce(F.col("_lemmas")[t], t))
    return joined.withColumn("lemma_tokens", F.when(F.col("_lemmas").isNull(), F.col("final_tokens")).otherwise(lemma)).drop("_id", "_of", "_lemmas")

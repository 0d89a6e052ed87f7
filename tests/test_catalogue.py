"""Queries of the catalogue over small tables: whole results, beside their SQL."""

import duckdb
import pytest
from conftest import values

from termloom.functions.phonetic import soundex_of
from termloom.plans import catalogue, oracle

TEXTS = ["Vaccine vacine élan straße 19 covid-19 Ashcraft", "größe x2 naïve_ñu мир2 vacíne 𝒳a Tymczak vаcine", None, ""]


@pytest.fixture(scope="module")
def directory(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("name, f", [("edit_distances", lambda t: distance(t, catalogue.MISSPELLED[0])), ("soundex_codes", soundex_of)])
def test_every_term(spark, directory, name, f):
    terms = values(catalogue.vocab(spark, directory))
    assert {"élan", "straße", "19", "covid-19", "vacíne", "vаcine", "𝒳a", "vacine"} <= set(terms)
    got = values(catalogue.queries()[name](spark, directory))
    assert got == sorted([(t, f(t)) for t in terms], key=repr)
    con = duckdb.connect()
    con.execute(f"create view documents as from read_parquet('{directory}/documents.parquet/*.parquet')")
    assert sorted(con.execute(oracle.oracle_sql()[name]).fetchall(), key=repr) == got

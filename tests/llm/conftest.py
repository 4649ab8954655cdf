import pytest
from pyspark.sql import Row

CLASH = {"row": "r", "t": "x", "id": 1, "hash": 2, "key": "k", "base": True, "score": 0.5, "lang_pred": "zz", "fp": 9, "group": 3,
         "length": 7, "piece": 1, "places": "p", "n_words": -1, "position": 4, "host": "h", "label": 0, "content": "c"}


@pytest.fixture(scope="session")
def frame(spark):
    """Tables from tuples, with extra columns whose names the operators use inside."""

    def make(rows, schema, clash=True):
        names = [c.split()[0] for c in schema.split(", ")]
        extra = {k: v for k, v in CLASH.items() if clash and k not in names}
        kinds = {str: "string", int: "bigint", float: "double", bool: "boolean"}
        full = schema + "".join(f", {k} {kinds[type(v)]}" for k, v in extra.items())
        return spark.createDataFrame([Row(*r, *extra.values()) for r in rows], full).repartition(3)

    return make


@pytest.fixture(scope="session")
def rows():
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)

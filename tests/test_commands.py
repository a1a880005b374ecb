"""The command catalogue names operators and queries that are there."""

from pyspark.sql import functions as F

from lodeline.functions import session
from lodeline.plans.commands import ROWS, WITHOUT_MEANING, catalogue, operator
from lodeline.plans.queries import QUERIES


def test_every_command_has_an_operator_and_a_query():
    for _, path, query in ROWS:
        assert callable(operator(path)), path
        assert not query or query in QUERIES, query
    names = [c for commands, *_ in ROWS for c in commands.split()]
    assert len(names) == len(set(names))
    assert not set(names) & set(WITHOUT_MEANING)
    assert len(catalogue()) > 400


def test_session(spark):
    ids = [r[0] for r in spark.range(50).repartition(4).select(session.unique_id(7)).collect()]
    assert len(set(ids)) == 50 and all(len(i) == 36 for i in ids)
    seconds, micros = spark.range(1).select(*session.clock()).first()
    assert seconds > 1_700_000_000 and 0 <= micros < 1_000_000
    assert spark.range(1).select(F.lit(session.VERSION)).first()[0] == "1.0"

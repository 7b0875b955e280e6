import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from formloom.session import local_session

    session = local_session(cpus=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 5, "x"),
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 5, "x"),
        (1, "another text under the same id", None, None, None, None),
        (2, None, None, "b", None, "y"),
        (3, "", "en", None, 0, None),
        (None, "a text without an id", "en", "b", 3, "z"),
        (5, "  \n\t ", "en", "a", 5, "z"),
        (6, "word " * 30000 + "4111 1111 1111 1111 end", "de", "a", 1, "z"),
        (7, "é中文 mixed ünïcode \U0001f600 text +1 (555) 010-0199 a@b.co", "fr", "ż", 1, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").withColumnRenamed("score", "size")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rankloom.runtime import build_session  # noqa: E402

DOCUMENTS = [
    ("river", "The river bends twice. Salmon swim up the river in spring. Bears wait at the falls."),
    ("bread", "Yeast makes dough rise. Dr. Mill bakes bread daily. The crust is brown and the crumb is soft."),
    ("stars", "Stars burn hydrogen. Old stars swell and turn red. Astronomers measure the light of stars."),
    ("trees", "Oak trees drop acorns. Birds hide acorns in spring. Roots drink water from the river bank."),
    ("metal", "Iron rusts in water. Steel is iron with carbon. Smiths heat metal until it is red."),
    ("blank", "  \n "),
]
QUESTIONS = [
    ("q1", "Where do salmon swim in spring?", "Up the river", ["river"]),
    ("q2", "What makes dough rise?", "Yeast", ["bread"]),
    ("q3", "Which stars turn red?", "Old stars", ["stars"]),
    ("q4", "What rusts in water and is metal?", "Iron", ["metal", "trees"]),
    ("q5", "zzz qqq", "", []),
    ("q6", "the and of", "", ["bread"]),
]


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(DOCUMENTS, "doc_id string, text string")


@pytest.fixture(scope="session")
def questions(spark):
    return spark.createDataFrame(
        QUESTIONS, "qid string, question string, answer string, relevant_doc_ids array<string>")


@pytest.fixture(scope="session")
def chunks(documents):
    from rankloom.operators.chunking import FixedSizeChunker
    from rankloom.runtime import materialize

    return materialize(FixedSizeChunker(8, 2).chunk(documents), "test-chunks")

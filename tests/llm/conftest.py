import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Clashing names: columns that operators use themselves.
CLASHES = {"digest": "x", "label": 1, "component": 2, "n": 3, "rank": 4, "cell": 5, "host": "h"}


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def documents(spark):
    """make(rows, extra=False): a documents table of (doc_id, text, source)."""

    def make(rows, extra=False):
        clash = tuple(CLASHES.values()) if extra else ()
        names = ", ".join(f"{k} {'string' if isinstance(v, str) else 'int'}" for k, v in CLASHES.items()) if extra else ""
        data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), *clash) for r in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long" + (", " + names if names else ""))

    return make


@pytest.fixture
def prose():
    """Deterministic prose: words(seed, n)."""
    import random

    def words(seed, n):
        draw = random.Random(seed)
        return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 8))) for _ in range(n))

    return words

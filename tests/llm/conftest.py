import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from tagtriage.session import get_session
    s = get_session("local[4]", app="tagtriage-llm-tests", shuffle_partitions=4,
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tt-llm-")})
    yield s


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, clashing column names."""
    long = "".join(f"word{i % 97} " for i in range(40_000))
    para = "the quick brown fox jumps over the lazy dog and runs on through the long green field " * 6
    rows = [(1, "a\nA line that many documents share\nb", "en", "s1", 1), (2, "A line that many documents share ", "en", "s1", 1),
            (3, "\tA LINE that many documents share\nc", None, None, None), (4, None, "en", "s2", None), (5, "", "en", "s2", 0),
            (6, "   \n\t", "en", "s2", 5), (7, long, "en", "s1", len(long)), (8, para, "en", "s1", 9), (9, para, "de", "s1", 9),
            (9, para, "de", "s1", 9), (10, "x " + para, "de", "s3", 9), (None, "no id here, only words of a text", "en", "s3", 4),
            (None, None, None, None, None), (11, "it's we'll 'tis 日本語 😀   12٣", "ja", "s3", 3), (12, "y" * 3000, "xx", "s1", 3000)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F
    for c in ("shard", "slot", "copy", "place", "n_lines", "keep", "h", "node", "part", "ids"):
        df = df.withColumn(c, F.lit(7))
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")

import hashlib
import re

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def sample(spark):
    """Documents with what may go wrong: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
    base = "the quick brown fox jumps over the lazy dog and then runs far away into the deep dark forest where nobody ever goes to look for it again on any day"
    near = base.replace("lazy", "sleepy") + " " + " ".join(f"tail{i}" for i in range(60))
    texts = [base + " " + " ".join(f"tail{i}" for i in range(60)), near, base, base, None, "", "   ", "one", "one two three", long, long + " end", "é ü ▁ 日本語 🤖\n\ttab", "A\nB\nA\nB\nsome line here.\nsome line here.", "x" * 3000]
    rows = [(i, t, ["en", "fr", None][i % 3], ["src0", None, "src1"][i % 3], len(t or ""), i, f"t{i}", 0.5) for i, t in enumerate(texts)]
    rows.append(rows[2])
    rows.append((None, "without an id", "en", "src0", 13, 0, "x", 0.0))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, slot int, row string, score double")
    # names that operators use themselves, and some that need quotes
    clashes = {"a.b": 1, "_source": 2, "_lang": 3, "_topic": 4, "_counts": 5, "_words": 6, "words": 7, "counts": 8, "size": 9, "of_lang": 10, "x`y z": 11, "key": 12, "lot": 13}
    return df.withColumns({k: F.lit(v) for k, v in clashes.items()}).repartition(3)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def words(text):
    return WORD.findall(text or "")

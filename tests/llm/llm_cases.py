"""Tables that hold the awkward cases: nulls, empty and long texts, repeated rows, clashing columns."""

import random
import uuid

from pyspark.sql import types as T

WORDS = "the of and thing ending onor reed thest anore inthe hered lyest oution erthe ha nd blest tions".split()
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("row", T.StringType()), T.StructField("key", T.StringType()), T.StructField("of", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("stratum", T.StringType()),
    T.StructField("rate", T.StringType()), T.StructField("toxic_score", T.StringType()), T.StructField("component_id", T.StringType())])


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "a", "es", "."]) for _ in range(n))


def rows():
    rng = random.Random(7)
    base, passage = prose(rng, 120), prose(rng, 30)
    edited = base.split(" ")
    edited[60] = "changed"
    texts = [base, " ".join(edited), base, base.upper(), None, "", " ", "one", "two words", prose(rng, 300) + "\n" + passage,
             passage + "\n" + prose(rng, 50), "x" * 5000, "ab " * 4000, "é😀 日本語 " * 60, "\n\n a\n\tb \x0b c \x0c\r d", prose(rng, 20000),
             "a" * 99, "b" * 100, "b" * 100, "c" * 250]
    out = [(i, t, ("en", "de", None)[i % 3], ("s0", "s0", "s1", None)[i % 4], len(t or ""), *["clash"] * 9) for i, t in enumerate(texts)]
    out += [out[0], out[0], out[4], (None, base, None, None, None, *["clash"] * 9), (None, None, None, None, None, *[None] * 9), (3, "one", "en", "s1", 3, *[None] * 9)]
    return out


def stored(spark, data, schema=SCHEMA):
    """The rows as a stored table."""
    from screenline.session import work_dir

    path = f"{work_dir(spark, 'cases')}-{uuid.uuid4().hex}"
    spark.createDataFrame(data, schema).repartition(3).write.parquet(path)
    return spark.read.schema(schema).parquet(path)

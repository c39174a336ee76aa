"""Pairs by classes of equal sets, against brute force and by what they shuffle."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import communities as C
from corvane.operators import retrieval as X


def shuffled(spark):
    """Rows that all stages so far have written for a shuffle."""
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}


def rows_shuffled(spark, df):
    before = shuffled(spark)
    n = df.agg(F.count(F.lit(1)), F.sum("a"), F.sum("b")).first()[0]
    return n, sum(v for k, v in shuffled(spark).items() if k not in before)


def test_pairs_of_copies_are_not_shuffled(spark):
    d = spark.range(1200).select("id", F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("tags"))
    n, rows = rows_shuffled(spark, X.pairs_sharing(d, "id", 2))
    assert n == 1200 * 1199 // 2 and rows < 10_000
    e = spark.createDataFrame([(1, 2), (5, 5000), (6000, 5)], "src long, dst long")
    n, rows = rows_shuffled(spark, C.tag_graph(d, "id", e))
    assert n == 1200 * 1199 // 2 + 2 and rows < 20_000


@pytest.mark.parametrize("size", [1, 3, 512])
def test_classes_against_brute_force(spark, size):
    rng = random.Random(3)
    rows = [(i, "ab"[i % 2] if i % 9 else None, rng.sample("abcdef", rng.randrange(0, 5)), i % 4) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, stack string, tags array<string>, k long")
    want = {(x[0], y[0], len(set(x[2]) & set(y[2])), x[3], y[3]) for x in rows for y in rows if x[0] < y[0] and x[1] and x[1] == y[1] and len(set(x[2]) & set(y[2])) >= 2}
    c = X.tag_classes(d, "id", "stack", carry=("k",), size=size)
    got = [tuple(r) for r in X.members_paired(X.sharing_classes(c, 2, "stack"), c, "shared", carry=("k",)).collect()]
    assert len(got) == len(want) and set(got) == want
    degree = {}
    for a, b, *_ in want:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    assert dict(map(tuple, X.sharing_degrees(d, "id", 2, "stack").collect())) == degree


def test_hot_items_are_joined_in_tiles(spark):
    d = spark.range(40).select(F.lit(1).alias("on"), F.col("id").alias("cls"))
    got = [tuple(r) for r in X.joined_in_tiles(d, ["on"], 7).select("cls_x", "cls_y").collect()]
    assert len(got) == len(set(got)) == 40 * 39 // 2


def test_first_tokens_are_those_of_the_whole_text(spark):
    texts = ["", None, "one two", "The QUICK brown-fox jumps over 12 123 lazy dogs", "aaa " * 300 + "bbb ccc ddd eee fff", "x" * 399 + "yz abc def ghi jkl mno", "alpha beta gamma delta epsil" * 40, "abKİcd Σ aaa bbb ccc ddd " * 30]
    texts += [("abc def ghi jkl " + "m" * n + " nop") for n in range(375, 390)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in d.select(T.first_tokens(F.col("t"), 5).alias("x"), F.slice(T.distinct_tokens(F.col("t")), 1, 5).alias("y"), T.first_tokens(F.col("t"), 5, prefix=20).alias("z")).collect():
        assert r.x == r.y == r.z


def test_tokens_are_runs_of_letters_and_digits(spark):
    """As splitting at everything else gives them."""
    texts = ["Don't stop: it's 1234, ab a_b\x0b\x1cx yzt", "aébcd", "\ttab\nline\r\nend  ", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    parts = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("t", F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+"), lambda x: (F.length(x) > 2) & ~x.isin(*T.STOP_BASE))
    for r in d.select(T.tokens(F.col("t")).alias("x"), parts.alias("y")).collect():
        assert r.x == r.y


@pytest.mark.parametrize("postings", [10, 500_000])
def test_synonyms_do_not_shuffle_pairs(spark, postings):
    """By block of term ranges as by brute force, with ties of names that are alike for seven bytes."""
    rng = random.Random(4)
    sets = [{f"{rng.choice(['same-prefix', 'w'])}{rng.randrange(60)}" for _ in range(25)} for _ in range(60)]
    d = spark.createDataFrame([("s", i, t) for i, x in enumerate(sets) for t in x], "stack string, doc long, token string")
    none = d.limit(0)
    before = shuffled(spark)
    got = {(r.term, r.synonym, r["rank"]) for r in X.synonyms(d, "stack", "doc", least_pmi=0.1, postings=postings).collect()}
    rows = sum(v for k, v in shuffled(spark).items() if k not in before)
    df = {t: sum(t in x for x in sets) for x in sets for t in x}
    want = set()
    for a in df:
        near = [(-math.floor(math.log(k * 60 / (df[a] * df[b])) * 1e6 + 0.5), b) for b in df if b != a and df[a] > 1 and df[b] > 1 for k in [sum(a in x and b in x for x in sets)] if k > 1]
        want |= {(a, b, k) for k, (p, b) in enumerate(sorted(x for x in near if x[0] <= -100_000)[:5], 1)}
    assert want and got == want
    assert postings == 10 or rows < 12_000  # 60 documents have some 14,000 pairs
    assert X.synonyms(none, "stack", "doc").count() == 0

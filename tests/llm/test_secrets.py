"""The forest against a plain walk, code that compiles, announcements in four languages, URLs of any length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import DATA
from sluiceway.llm import secretscan


def walk(tree, row):
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_equals_a_plain_walk(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((500, 22)), 2)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] + x[:, 7] > 1)).astype(float)
    trees = [*secretscan.forest(x, y, 7, seed), 0.25]
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "k int, x array<double>")
    got = {r.k: r.s for r in rows.select("k", secretscan.score_of(trees, F.col("x")).alias("s")).collect()}
    assert all(abs(got[k] - sum(walk(t, r) for t in trees) / len(trees)) < 1e-9 for k, r in enumerate(x))
    nodes, roots = secretscan.as_table(trees)
    assert len(roots) == 8 and all(n[0] == -1 or max(n[2], n[3]) < len(nodes) for n in nodes)
    assert rows.select(secretscan.score_of([], F.col("x")).alias("s")).first().s == 0.0


def test_generated_code_compiles(spark):
    """Spark does not fall back to interpreted evaluation."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = {"spark.sql.codegen.fallback": "false", "spark.sql.codegen.factoryMode": "CODEGEN_ONLY"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        df = secretscan.scan(docs)
        assert df.count() > 0
        for stage in df._jdf.queryExecution().debug().codegenToSeq().mkString("\n").split("maxMethodCodeSize")[1:]:
            assert 0 < int(stage.split(",")[0].strip("=: ")) < 64_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_announced_in_four_languages(spark):
    texts = {"passwort=Geheim123!": "Geheim123!", "Kennwort: qW3!rTz9": "qW3!rTz9", "mot de passe : Xk9fd2Qa": "Xk9fd2Qa", "mot_de_passe=Zz8-tre!": "Zz8-tre!", "contraseña: tR7#mPq2": "tR7#mPq2", "clave = 'hJ4kL9pQ'": "hJ4kL9pQ", "mdp=Qz8-trex": "Qz8-trex", "la clave: es": None, "Passwort: bitte": None}
    docs = spark.createDataFrame([(k, t, "") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    every = {(r.doc_id, r.candidate) for r in secretscan.candidates(docs, F.lit("")).collect()}
    assert not [t for k, (t, s) in enumerate(texts.items()) if s and (k, s) not in every]
    found = {r.doc_id: r.secret for r in secretscan.scan(docs).collect()}
    wrong = [(t, s, found.get(k)) for k, (t, s) in enumerate(texts.items()) if found.get(k) != s]
    assert len(wrong) <= 1, wrong


def test_urls_of_any_length(spark):
    user, word = "u" * 300, "Zq8-" * 80
    docs = spark.createDataFrame([(1, f"postgres://{user}:{word}@host/db", ""), (2, "http://" + "a" * 200_000, ""), (3, "x://:" * 30_000, "")], "doc_id long, text string, source string")
    got = {(r.doc_id, r.candidate) for r in secretscan.candidates(docs, F.lit("")).collect()}
    assert (1, word) in got

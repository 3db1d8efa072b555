"""Every operator and stage on rows with all names it could use itself, and with texts of several MB."""

import uuid

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geoweft.llm import bpe, fingerprints, linededup, neardup, packing, pii, quality, secrets, simhash, token_store
from geoweft.session import shared_dir

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
NAMES = """row bucket guest host top doc id fp least node root component component_id token at n c n2 at2 b a base weak found links spans
    queue begin length skip block ids pieces digest payload pos stop leaf start rank one chunks kept lang_ r h1 h2 first copies chars gone copy k1 k2 left
    hot_first hot_chars n_lines n_removed lines name leader size end word n_words base_failed char_distance word_distance fingerprint doc_tokens
    sequence_id offset _simhash_row _kept_row _near_row _secret_row _found_row _found_spans _quality_lang _sum _base _c value""".split()


@pytest.fixture(scope="module")
def clashes(spark, odd_docs):
    """Odd rows, a text of 3 MB and columns under every such name."""
    long_row = spark.createDataFrame([(90, "a long text, user: alice99 and pwd = hunter22x; number", "en", "b", 1, "q")], odd_docs.schema)
    long_row = long_row.withColumn("text", F.concat("text", F.expr("array_join(transform(sequence(1, 300000), x -> concat(x, if(x % 9 = 0, '\\n', ' '))), '')")))
    rows = odd_docs.unionByName(long_row).withColumns({x: F.lit(k) for k, x in enumerate(NAMES)})
    path = f"{shared_dir(spark)}/clashes-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.parquet(path)


def key(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("run", [
    lambda d: bpe.bpe_digests(d, WORD), fingerprints.fingerprint_neighbours, simhash.near_duplicates, quality.judged, linededup.report, pii.scan,
    lambda d: secrets.scan(d).drop("row"), lambda d: packing.pack(d, BYTE).groupBy("doc_id", "doc_tokens").agg(F.sum("length")),
], ids=["op1", "op2", "op6", "op7", "op8", "op10", "op9", "op4"])
def test_queries_ignore_other_columns(run, clashes):
    assert key(run(clashes)) == key(run(clashes.select("doc_id", "text", "lang", "source")))


def test_token_store_ignores_other_columns(spark, clashes):
    got = []
    for k, docs in enumerate((clashes, clashes.select("doc_id", "text"))):
        out = f"{shared_dir(spark)}/clash-store-{uuid.uuid4().hex}"
        token_store.write_store(docs, out, WORD)
        got.append(key(token_store.read_digests(spark, out)))
    assert got[0] == got[1]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:4]] + [lambda s, d, _: simhash.representatives(d), lambda s, d, _: linededup.remove_lines(d).select(*d.columns)], ids=["quality", "lines", "near", "secrets", "simhash", "remove_lines"])
def test_stages_keep_other_columns(spark, stage, clashes):
    done = stage(spark, clashes, "")
    assert done.columns == clashes.columns and [t for _, t in done.dtypes] == [t for _, t in clashes.dtypes]
    assert done.where(" or ".join(f"`{x}` <> {k}" for k, x in enumerate(NAMES))).isEmpty()
    plain = stage(spark, clashes.select("doc_id", "text", "lang", "source", "n_chars"), "")
    assert key(done.select(*plain.columns)) == key(plain)


def test_near_duplicates_of_a_large_family(spark):
    """Near copies by the hundred are one component without being paired with each other."""
    words = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*words[: k % 100], f"x{k}", *words[k % 100 + 1 :]])) for k in range(600)]
    df = spark.createDataFrame([(k, t) for k, t in rows], "doc_id long, text string")
    assert [x.doc_id for x in neardup.representatives(df).collect()] == [0]
    shared = neardup.shared_prefixes(df, 5, 0.8)
    assert neardup.star_pairs(neardup.in_components(shared, None), 0.8).count() < 30 * len(rows)

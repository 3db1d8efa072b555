"""The whole pipeline against slow versions of its stages, one after the other."""

import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import slow_secrets
from tests.llm.test_documents import SECRETS, first_kinds, slow_line_dedup, slow_measures, slow_verdicts

SMALL = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def kept_by_quality(rows):
    distances = slow_verdicts(rows)
    for x in rows:
        text = x.text or ""
        n, repeat = len(words_of(text)), slow_measures(text)[3]
        chars, common = distances[x.doc_id]
        if not (n < 50 or 100 * repeat > 50 * n or (chars or 0) > 0.25 or (common or 0) > 0.34):
            yield x.doc_id, text


def without_repeated_lines(docs):
    gone = slow_line_dedup(docs, 150)
    return [(k, "\n".join(x for i, x in enumerate(text.split("\n")) if (k, i) not in gone)) for k, text in docs]


def one_of_each_family(docs):
    sets = []
    for _, text in docs:
        words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [d for k, d in enumerate(docs) if root(k) == k]


def without_secrets(text):
    return slow_secrets.redacted(text, first_kinds(text, SECRETS))


def test_the_pipeline_equals_its_slow_stages(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    docs = one_of_each_family(without_repeated_lines(list(kept_by_quality(rows))))
    assert 0.3 * len(rows) < len(docs) < len(rows)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: np.array([*library.encode(without_secrets(text), add_special_tokens=False).ids, 0], "<u4") for k, text in docs}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {(r.doc_id, r.doc_tokens) for r in got} == {(k, len(ids)) for k, ids in want.items()}
    at = {k: 0 for k in want}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and zlib.crc32(want[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
        at[r.doc_id] += r.length
    assert at == {k: len(ids) for k, ids in want.items()}

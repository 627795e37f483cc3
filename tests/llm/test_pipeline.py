"""The pipeline and the queries on the driver's smallest tables, against plain versions."""

import os
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from vecspark.llm import licenses
from vecspark.llm.common import table
from vecspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def documents(spark):
    return sorted((r.doc_id, r.text) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect())


def learned(documents, labels):
    return brute.Toxicity([(t, int(labels[i] > 0)) for i, t in documents if labels.get(i) is not None and zlib.crc32(str(i).encode()) % 5])


def test_pipeline_equals_its_stages_one_by_one(spark, documents):
    from tokenizers import Tokenizer

    labels = {r.doc_id: r.toxic for r in table(spark, FOLDER, "labels").collect()}
    model = learned(documents, labels)
    left = [(i, t) for i, t in documents if model.score(t) < 0.5]
    groups = brute.components({i: brute.fingerprint(t) for i, t in left})
    left = [(i, t) for i, t in left if groups[i] == i]
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    leaked = {d for d, *_ in brute.leaks(left, items)}
    library = Tokenizer.from_file(corpus_pipeline.default_vocabulary())
    want = {}
    for i, text in left:
        if i in leaked:
            continue
        out, at = [], 0
        for _, a, b in brute.secrets(text):
            if a >= at:
                out += [text[at:a], "[REDACTED]"]
            at = max(at, b)
        ids = library.encode("".join([*out, text[at:]]), add_special_tokens=False).ids
        want[i] = (len(ids), brute.sha(",".join(map(str, ids))))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want


def test_stages_keep_columns_and_odd_rows(spark):
    rows = [(1, None, "en", "s", None, "mine"), (1, None, "en", "s", None, "mine"), (None, "", None, None, 0, None), (3, "token = abcdefgh1", "en", "s", 17, "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, secrets string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and stage(spark, docs.where("false"), FOLDER).count() == 0
    assert {r.n_chars for r in out.where("doc_id = 3").collect()} == {10}


def test_stages_keep_columns_of_any_name_and_judge_rows_by_their_text(spark):
    item = next(r.text for r in table(spark, FOLDER, "benchmark").orderBy("item_id").collect() if r.text)
    clash = ["toxicity", "toxic_passages", "secrets", "changed", "fingerprint", "component_id", "text_hash", "_f", "_gone", "_hash", "_secrets", "_toxicity"]
    rows = [(None, item), (None, "nothing in it"), (7, f"before {item} behind"), (7, "also clean"), (8, "token = abcdefgh1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.concat(F.lit(c), "text").alias(c) for c in clash)).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        got = out.collect()
        assert all(r[c].startswith(c) for r in got for c in clash)
        assert sorted(r.text for r in got) == sorted({"benchmark_leaks": ["nothing in it", "also clean", "token = abcdefgh1"], "secrets": [*(t for _, t in rows[:-1]), "[REDACTED]"]}.get(name, [t for _, t in rows]))


def test_op1_query(spark, documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op1_suffixes"](spark, FOLDER).collect()}
    assert got == {i: w for (i, _), w in zip(documents, brute.repeats(documents), strict=True)}


def test_op2_query(spark, documents):
    prints = {i: brute.fingerprint(t) for i, t in documents}
    groups = brute.components(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, FOLDER).collect()} == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}


def may_match(words, markup):
    """Whether the words have all that the template can't do without."""
    plain = re.sub(r"\[\[[^\[\]]*\]\]", " ", re.sub(r"\[\[[^\[\]]*\]\]", " ", markup))
    return all(set(t.split("|")) & set(words) for t in re.sub(r"\{\{\d+\}\}", " ", plain).split())


def test_op4_query(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op4_licenses"](spark, FOLDER).collect()}
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    for i, text in documents:
        words = brute.WORD.findall(brute.lower(text))
        places = [(label, at) for label, p in phrases.items() for at in range(len(words)) if words[at : at + len(p.split())] == p.split()]
        starts = [at for _, at in places]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for k, _ in places})))
        found = brute.licenses(text, [t for t in (*licenses.BASE, *licenses.TEMPLATES) if may_match(words, t[1])])
        assert r.labels == ",".join(sorted({k for k, *_ in found})) and r.score == pytest.approx(brute.coverage(len(words), found))


def test_op5_query(spark, documents):
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    assert {(r.doc_id, r.item_id, r.shared, r.n_shingles) for r in QUERIES["op5_decontamination"](spark, FOLDER).collect()} == brute.leaks(documents, items)


def test_op6_query(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op6_toxicity"](spark, FOLDER).collect()}
    assert len(got) == len(documents) and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    labels = {r.doc_id: r.toxic for r in table(spark, FOLDER, "labels").collect()}
    model = learned(documents, labels)
    assert {i: r.score for i, r in got.items()} == {i: pytest.approx(model.score(t), abs=1e-6) for i, t in documents}
    assert sum(got[i].predicted == y for i, y in labels.items() if got[i].held_out) >= 0.9 * sum(got[i].held_out for i in labels)


def test_op7_query(spark, documents):
    rows = QUERIES["op7_rendezvous"](spark, FOLDER).collect()
    texts = dict(documents)
    assert all((r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len((texts[r.doc_id] or "").encode()) + 16, zlib.crc32((texts[r.doc_id] or "").encode()), "key", brute.shard(r.doc_id, 40), brute.shard(r.doc_id, 41)) for r in rows)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(documents) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_op8_query(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.default_vocabulary())
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in documents}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op8_bpe"](spark, FOLDER).collect()} == {i: (len(x), brute.sha(",".join(map(str, x))), brute.sha(library.decode(x, skip_special_tokens=False))) for i, x in ids.items()}


def test_op9_query(spark):
    rows = QUERIES["op9_media"](spark, FOLDER).collect()
    asked = {r.vec_id for r in table(spark, FOLDER, "embeddings").where("vec_id % 50 = 0").collect()}
    assert {r.query_id for r in rows} == asked and sum(r.class_id == r.query_id for r in rows) >= 0.9 * len(asked)


def test_op10_query(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op10_secrets"](spark, FOLDER).collect()}
    for i, text in documents:
        found = brute.secrets(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert got[i].base_sha256 == brute.sha(joined) and (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == n for k, *_ in found) for n in ("assign", "access", "hex"))

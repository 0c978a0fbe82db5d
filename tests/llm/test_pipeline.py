import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ragloom.llm import mixing


@pytest.fixture
def parts(spark):
    """Shuffles and reads of small tables have several partitions."""
    conf = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "20k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_packing_follows_training_positions(spark, parts, tmp_path):
    r = random.Random(21)
    text = lambda: " ".join("".join(r.choice("abcdefghijkl") for _ in range(5)) for _ in range(r.choice((5, 20, 60, 400))))
    docs = spark.createDataFrame([(i, text(), f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    corpus_pipeline.mix_sources(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    assert len(mixed.inputFiles()) > 4
    pieces = corpus_pipeline.pack_sequences(spark, mixed, "").collect()
    assert len({p.sequence_id >> 33 for p in pieces}) > 4
    got = [p.doc_id for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)) if p.start == 0]
    places = mixing.plan(docs).select("doc_id", F.explode("_places").alias("p")).select("doc_id", "p.position", F.xxhash64("doc_id", "p.copy").alias("tie")).collect()
    assert got == [p.doc_id for p in sorted(places, key=lambda p: (p.position, p.tie))]


def _words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with toxic documents, exact and near copies, secrets, nulls, repeated rows, one long text and clashing extra columns."""
    r = random.Random(33)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(400)]
    rows = []
    for i in range(160):
        text = " ".join(r.choice(words) for _ in range(r.choice((12, 60, 200))))
        if i % 8 == 1:
            text += " you vuxkrot and grobzak"
        if i % 8 == 3:
            text += ' token = "' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"'
        rows.append((i, text))
    rows += [(200, rows[0][1]), (201, rows[2][1].upper()), (202, rows[4][1] + " one more"), (203, None), (204, ""), (205, " \n "), (206, " ".join(rows[5][1] for _ in range(60))), rows[10], (None, rows[6][1])]
    out = [(i, t, "en", None if i is not None and i % 9 == 4 else f"s{(i or 0) % 3}", len(t or ""), 0.5, True, [1]) for i, t in rows]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, removed array<int>").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 1)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), out


def test_every_stage_keeps_its_promise(spark, folder):
    from test_jaccard import brute, key

    from ragloom.llm import mixing as mix_module
    from ragloom.llm import packing

    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.drop_toxic(spark, docs, path)
    assert kept.columns == columns
    toxic = {i for i, t, *_ in rows if t and "vuxkrot" in t}
    left = [(x.doc_id, x.text) for x in kept.collect()]
    assert not toxic & {i for i, _ in left} and len(left) >= len(rows) - len(toxic) - 2
    kept = corpus_pipeline.drop_near_copies(spark, kept, path)
    assert kept.columns == columns
    one = [(x.doc_id, x.text) for x in kept.collect()]
    want = {(d, t) for (d, n, c), (_, t) in zip(brute(left), left, strict=True) if d == c or not n}
    assert sorted(set(one), key=lambda x: (key((x[0],)), x[1] or "")) == sorted(want, key=lambda x: (key((x[0],)), x[1] or ""))
    hidden = corpus_pipeline.hide_secrets(spark, kept, path)
    after = {x.doc_id: x.text for x in hidden.collect()}
    assert hidden.columns == columns and len(after) == len({i for i, _ in one})
    for i, t in one:
        assert "[SECRET]" in after[i] if t and "token = " in t else after[i] == t
    mixed = corpus_pipeline.mix_sources(spark, hidden, path)
    assert mixed.columns == columns
    taken, got = {}, {}
    for x in mix_module.plan(hidden).select("doc_id", F.col("_taken").alias("t")).collect():  # a row may be there twice
        taken[x.doc_id] = taken.get(x.doc_id, 0) + x.t
    for x in mixed.collect():
        got[x.doc_id] = got.get(x.doc_id, 0) + len(_words(x.text))
    assert got == {k: v for k, v in taken.items() if v}
    mixed.write.parquet(f"{path}/mixed")
    mixed = spark.read.parquet(f"{path}/mixed")
    pieces = corpus_pipeline.pack_sequences(spark, mixed, path).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    tokenizer.encode_special_tokens = True
    assert sum(p.length for p in pieces) == sum(len(tokenizer.encode(x.text or "", add_special_tokens=False).ids) + 1 for x in mixed.collect())


def test_run_chains_the_stages(spark, folder):
    path, rows = folder
    out = corpus_pipeline.run(spark, path)
    ids = {x.doc_id for x in out.select("doc_id").distinct().collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "secret_scan", "mixing", "packing"]
    assert not ids & {i for i, t, *_ in rows if t and "vuxkrot" in t} and 200 not in ids and len(ids) > 60


def test_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    for name in ("documents", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

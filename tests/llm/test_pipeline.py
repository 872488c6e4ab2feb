"""The pipeline's stages on the smallest tables."""

import hashlib
import os
import re
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from loomsift.llm import _common, langid
from loomsift.llm._common import shared_folder
from loomsift.llm.line_dedup import drop_duplicate_lines

DATA = "/root/testdata/sf0.001"


def test_stages_keep_their_promises(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
    assert seen["language_id"].count() >= 0.95 * before
    assert seen["line_dedup"].where(F.col("n_chars") != F.length("text")).count() == 0
    lines = seen["line_dedup"].select(F.explode(F.split("text", "\n")).alias("l")).where(F.length("l") >= 30)
    assert lines.count() == lines.distinct().count()
    ids = {r[0] for r in seen["near_dedup"].select("doc_id").collect()}
    assert len(ids) == seen["near_dedup"].count()
    assert {r[0] for r in seen["mix_sources"].select("doc_id").collect()} == ids
    tokens = corpus_pipeline.pack(spark, docs, DATA)
    assert tokens.where("piece = 0").count() == docs.count()


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_clashing_names_and_repeated_keys(spark, tmp_path):
    prose = "the keeper of the northern light walked along the shore and counted every boat that came in before the storm reached the bay"
    lines = [f"{prose} number one"]
    rows = [
        (1, prose, "en", "web"),
        (1, prose, "en", "web"),  # a repeated row
        (7, "\n".join([lines[0], "a line of text that only this one of the two documents has"]), "en", "web"),
        (7, "\n".join(["another opening line, which no other document has either", lines[0]]), "en", "books"),
        (None, "something else that nobody else wrote in this form\nand a first line that stands only here, at some length", "en", None),
        (None, None, None, None),
        (9, "", "en", "web"),
    ]
    kind = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, kind)
    for name in ("lang_id", "n_dropped", "mix", "_", "row", "key", "dropped", "place", "component_id", "name", "h1", "family", "redaction", "none"):
        docs = docs.withColumn(name, F.lit("kept"))
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), DATA)
        assert docs.columns[4:8] == ["lang_id", "n_dropped", "mix", "_"]
        assert docs.where("lang_id = 'kept' and mix = 'kept' and _ = 'kept' and n_dropped = 'kept'").count() == docs.count()
    assert corpus_pipeline.pack(spark, docs, DATA).count() > 0
    deduped = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, kind), DATA)
    of_seven = sorted(r.text for r in deduped.where("doc_id = 7").collect())
    # One of the two loses the line they share, and neither anything else.
    assert [t.count("\n") for t in of_seven] in ([0, 1], [1, 0])
    assert "".join(of_seven).count(lines[0]) == 1
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, kind), DATA).collect()
    assert sum(r.doc_id == 1 for r in kept) == 1 and sum(r.doc_id is None for r in kept) == 2


def near_groups(texts):
    """Groups of texts linked by Jaccard similarity of 0.8 on five words, by all pairs."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in words]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and group[i] != group[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def test_near_dedup_keeps_one_of_each_group_however_the_input_is_split(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    rows = docs.collect()
    group = near_groups([r.text for r in rows])
    assert len(set(group)) < len(rows)
    out = corpus_pipeline.near_dedup(spark, docs, DATA)
    was = spark.conf.get("spark.sql.files.minPartitionNum", None)
    try:
        # As when executors come or go between building the result and reading it.
        spark.conf.set("spark.sql.files.minPartitionNum", "11")
        kept = [r.doc_id for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if was is None else spark.conf.set("spark.sql.files.minPartitionNum", was)
    of = {r.doc_id: g for r, g in zip(rows, group, strict=True)}
    assert sorted(of[i] for i in kept) == sorted(set(group))


def test_texts_of_one_key_with_equal_hashes_lose_nothing(spark):
    ids = spark.range(400_000).select(F.concat(F.lit("an opening line of a document that nobody else has, number "), "id").alias("t"))
    hashed = ids.select("t", F.hash(F.lit("text"), "t").alias("h1"), F.hash("t").alias("h2"))
    for h in ("h1", "h2"):
        alike = hashed.groupBy(h).agg(F.collect_list("t").alias("t")).where(F.size("t") > 1).first().t[:2]
        for key in (None, 5):
            shared = "a line that both of the documents have in common, so that one of them loses it"
            rows = [(key, alike[0]), (key, alike[1]), (9, alike[0] + "\n" + shared), (10, shared)]
            got = drop_duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), edits=0).select("doc_id", "text").collect()
            assert sorted(r.text for r in got if r.doc_id == key) == sorted(alike)
            assert {r.doc_id: r.text for r in got if r.doc_id in (9, 10)} == {9: shared, 10: ""}


def test_run_leaves_only_what_its_result_reads(spark, tmp_path):
    folder = shared_folder(spark).removeprefix("file:")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    new = [x for x in os.listdir(folder) if x not in before]
    assert [x for x in new if x.startswith("rows-")] == []
    (pipeline,) = [x for x in new if x.startswith("pipeline-")]
    assert os.listdir(f"{folder}/{pipeline}") == ["3-mix_sources"]


def test_line_dedup_of_very_long_texts(spark):
    lines = [hashlib.sha256(b"%d" % i).hexdigest() for i in range(20_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(reversed(lines)) + "\nand one line that only the second has, at its end"), (3, "x" * 500_000)]
    got = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect()}
    assert got[2].text == "and one line that only the second has, at its end" and got[3].text == rows[2][1]


def test_texts_reach_workers_in_batches_of_bounded_bytes(spark, tmp_path):
    setting = _common.BATCH_SETTING
    long = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("word "), 800).alias("text"))  # 24 MB, below the 10,000 rows of a batch

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    stages = dict(corpus_pipeline.STAGES)
    try:
        for name in ("language_id", "near_dedup", "pack"):
            spark.conf.unset(setting)
            stages[name](spark, docs, DATA)
            found = long.mapInArrow(sizes, "n long, bytes long").collect()
            assert sum(r.n for r in found) == 6000
            assert max(r.bytes for r in found) < 2 * _common.BATCH_BYTES, name
        # A bound of the session's own stays, and a run leaves the session as it was.
        spark.conf.set(setting, "1000000")
        stages["pack"](spark, docs, DATA)
        assert spark.conf.get(setting) == "1000000"
        spark.conf.unset(setting)
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        corpus_pipeline.run(spark, str(tmp_path))
        assert spark.conf.get(setting, None) is None
    finally:
        spark.conf.unset(setting)


def test_letter_tables_take_no_list_of_all_characters(monkeypatch):
    monkeypatch.setattr(langid, "_tables", [])
    tracemalloc.start()
    try:
        is_letter, lower = langid._letters()
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(is_letter) == len(lower) == 0x110000 and most < 32e6
    assert is_letter[ord("é")] and not is_letter[ord("7")] and lower[ord("É")] == ord("é") and lower[ord("İ")] == ord("İ")

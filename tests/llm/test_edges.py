"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest

from silkgraph.llm import decontaminate, jaccard_join, language_id, license_scan, packing, preference, quality_classifier, quality_rules, substring, warc
from silkgraph.llm.common import shared_dir

LONG = "x" * 100_000 + " " + "tok " * 30_000
DOCS = [(1, "Some plain text, All rights reserved.", "en", "s"), (1, "Some plain text, All rights reserved.", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (None, "no id here", "fr", "s"), (None, None, None, None), (4, LONG, "de", "t"), (5, "\n\n \t", "en", "t")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 7, "p", [1], 0, "q", 5, "t", [2], 1, "h", 3, 4, 6, "x") for r in DOCS]
    return spark.createDataFrame(rows, SCHEMA + ", pos long, w string, hits array<long>, __at long, path string, __id long, __th string, __spans array<long>, __bad long, __hits string, __n int, __rank int, __l int, component string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=((1, 1, 0), (3, 0, None), (None, 1, 1), (4, None, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def bench(spark, rows=((1, "plain text all rights reserved"), (2, None), (None, "no id here"), (3, "...!"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))


ALL = [1, 1, 2, 3, 4, 5, None, None]


def test_one_row_for_each(spark, docs):
    assert ids(decontaminate.contamination(docs, bench(spark))) == ALL
    assert ids(license_scan.scan_licenses(docs)) == ALL
    assert ids(quality_rules.quality_rules(docs)) == ALL
    assert ids(language_id.predict(docs, language_id.fit(docs))) == ALL
    assert ids(substring.dedup_digest(docs)) == ALL
    assert ids(jaccard_join.jaccard_components(docs)) == ALL
    assert ids(quality_classifier.classify(docs, labels(spark))) == ALL
    assert set(ids(packing.pack_documents(docs))) == set(ALL)


def test_defined_results(spark, docs):
    hit = {r["doc_id"]: r for r in decontaminate.contamination(docs.where("doc_id is not null"), bench(spark)).collect()}
    assert (hit[1]["n_hit"], hit[1]["n_items"], hit[1]["contaminated"]) == (5, 1, True)
    assert (hit[2]["n_words"], hit[3]["n_words"], hit[5]["contaminated"]) == (0, 0, False)
    lang = {r["doc_id"]: r for r in language_id.predict(docs.where("doc_id is not null"), language_id.fit(docs)).collect()}
    assert lang[2]["lang_pred"] == lang[3]["lang_pred"] == lang[5]["lang_pred"] == "und"
    comp = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs.where("doc_id is not null")).collect()}
    assert comp[1] == (4, 1) and comp[2] == (0, 2) and comp[4] == (2, 4)
    packed = {(r["doc_id"], r["piece"]): r["length"] for r in packing.pack_documents(docs.where("doc_id in (2, 3, 5)")).collect()}
    assert packed == {(2, 0): 1, (3, 0): 1, (5, 0): 1}


def test_empty_tables(spark, none):
    for df in (
        decontaminate.contamination(none, bench(spark)), license_scan.scan_licenses(none), quality_rules.quality_rules(none), language_id.predict(none, language_id.fit(none)), substring.dedup_digest(none),
        jaccard_join.jaccard_components(none), quality_classifier.classify(none, labels(spark, ())), packing.pack_documents(none), preference.format_preferences(preference.swapped_pairs(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
    ):
        assert df.count() == 0


def test_filters_keep_columns(spark, docs):
    for df in (decontaminate.decontaminate(docs, bench(spark, ())), substring.dedup(docs), jaccard_join.near_dedup(docs), quality_classifier.keep_good(docs, labels(spark))):
        assert df.columns == docs.columns
    assert ids(decontaminate.decontaminate(docs, bench(spark))) == [2, 3, 4, 5, None]  # the row without id has a hit too
    cut = decontaminate.decontaminate(docs, bench(spark), mode="spans")
    assert cut.columns == docs.columns and ids(cut) == ALL
    assert ids(jaccard_join.near_dedup(docs)) == [1, 2, 3, 4, 5, None, None]


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    rows = [(1, "plain text all rights reserved"), (1, "a clean one of five words"), (1, None), (None, "plain text all rights reserved"), (None, "clean")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontaminate.decontaminate(df, bench(spark)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[1], rows[2], rows[4]], key=str)
    cut = decontaminate.decontaminate(df, bench(spark), mode="spans").collect()
    assert sorted(map(tuple, cut), key=str) == sorted([(1, ""), rows[1], rows[2], (None, ""), rows[4]], key=str)
    once = [jaccard_join.near_dedup(df.repartition(n)).where("doc_id = 1").collect() for n in (1, 4)]
    assert once[0] == once[1] and len(once[0]) == 1


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "(Keep) this, Plain TEXT; all rights reserved! and that.")], "doc_id long, text string")
    assert decontaminate.decontaminate(docs, bench(spark), mode="spans").first()["text"] == "(Keep) this, and that."


def test_warc_round_trip(spark):
    big = "ß" * 700
    pages = [(1, "http://a/1", big, "z"), (2, "http://a/2", big, "z"), (2, "http://a/2", big, "z"), (3, None, None, "z"), (None, "u", big, "z"), (4, "x y\r\nz", "", "z"), (5, "http://a/5", "p" * 999, "z"), (6, "http://a/6", "p" * 999, "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string")
    path = shared_dir(spark, "t")
    manifest = warc.write_warc(df, path, shard_bytes=2500, roll_bytes=200).collect()
    assert len(manifest) > 2
    rows = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_warc(spark, path).collect()), key=str)
    assert rows == sorted([(1, "revisit", 2, 1400), (2, "response", None, 1400), (2, "response", None, 1400), (3, "response", None, 0), (0, "response", None, 1400), (4, "response", None, 0), (5, "response", None, 999), (6, "response", None, 999)], key=str)
    again = shared_dir(spark, "t")
    assert sorted(map(tuple, warc.write_warc(df.repartition(3), again, shard_bytes=2500, roll_bytes=200).collect())) == sorted(map(tuple, manifest))


def test_shards_are_bounded_whatever_the_ids(spark):
    from silkgraph.llm.common import materialize

    near = [(i, "u", f"{i:04d}" * 25) for i in range(400)]
    one = [(77, "u", f"{i:04d}" * 25) for i in range(200)]
    for rows in (near, [*near, (1 << 60, "u", "far")], [*near, (-(1 << 62), "u", "far"), ((1 << 63) - 1, "u", "end")], [*near, *one], [*near, *[(None, *r[1:]) for r in one]], [(5, "u", None)], []):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
        narrow = materialize(warc.index(df), "index")
        layout = warc.Layout(narrow, 8000)
        placed = narrow.withColumn("shard", layout.column("page_id", "digest")).collect()
        held = {}
        for r in placed:
            held[r["shard"]] = held.get(r["shard"], 0) + r["bytes"] + 512
        total = sum(held.values())
        assert max(held.values(), default=0) <= 2 * 8000 and layout.shards <= 2 * (1 + total // 8000) + 3 and max(held, default=0) < layout.shards
        in_order = sorted((r for r in placed if r["page_id"] is not None), key=lambda r: (r["page_id"], r["digest"]))
        assert [r["shard"] for r in in_order] == sorted(r["shard"] for r in in_order)


def test_preferences(spark):
    turns = [(2, 0, "user", "hi"), (2, 1, "assistant", "good <|end|>"), (3, 0, "user", "yo"), (3, 1, "assistant", "bad"), (4, 0, None, None), (None, 0, "user", "x"), (2, 2, "user", "after")]
    out = {r["pair_id"]: r for r in preference.format_preferences(preference.swapped_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    assert out[2]["prompt"] == "<|user|>\nhi\n<|end|>\n" and out[2]["n_prompt_turns"] == 1
    assert out[2]["chosen"] == "<|assistant|>\ngood < |end|>\n<|end|>\n" and out[2]["rejected"] == "<|assistant|>\nbad\n<|end|>\n"
    span = out[2]["chosen_mask"][0]
    assert out[2]["chosen"][span["start"] : span["end"]] == "good < |end|>"
    assert out[4]["chosen"] == out[4]["rejected"] == "" and out[4]["n_prompt_turns"] == 1


def test_pipeline_on_odd_rows_and_an_empty_table(spark, docs, none, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for rows, name in ((docs, "odd"), (none, "none")):
        for stage, f in pipeline.STAGES:
            rows = f(spark, rows, str(tmp_path))
            rows.write.parquet(str(tmp_path / name / stage))
            rows = spark.read.parquet(str(tmp_path / name / stage))
            if stage == "quality classifier" and name == "odd":
                assert set(rows.columns) == set(docs.columns) and set(ids(rows)) <= {1, 4, None}
        assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert {r["doc_id"] for r in rows.collect()} <= ({4, None} if name == "odd" else set())

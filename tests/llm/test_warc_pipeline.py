"""Archives, the pipeline and the registered queries."""

import hashlib
import io
import re
import struct

import duckdb
import pytest
import zstandard

import check_queries
import corpus_pipeline
from recurring_metrics.llm import catalog, exact_dedup, language_id, minhash_dedup, warc_dict
from recurring_metrics.sources.io import scratch_path
from tests.llm.conftest import prose

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + prose(1, 400) + "</p>"
    rows = [
        (1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://a/4", "é" * 10),
        (5, "http://a/5", "é" * 10), (6, "u\r\nX: y", None), (7, "", ""), (None, "http://n", big), (8, "x", big + "!"),
        (8, "x", big + "!"), (9, "y", "z" * 1000), (10, "y", "z" * 1000), (11, "y", "z" * 999), (12, "y", "z" * 999),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")


def brute_pages(rows):
    out, stays = [], {}
    for r in rows:
        if r["page_id"] is not None:
            stays[r["html"]] = max(stays.get(r["html"], -1), r["page_id"])
    for r in rows:
        data = (r["html"] or "").encode()
        to = stays.get(r["html"])
        revisit = len(data) >= 1000 and to is not None and to != r["page_id"]
        out.append((r["page_id"], len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(map(str, out))


def test_round_trip(spark, pages):
    got = warc_dict.round_trip(spark, pages, scratch_path(spark, "warc"), with_payload=True).collect()
    keys = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(str(tuple(r[k] for k in keys)) for r in got) == brute_pages(pages.collect())
    texts = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    assert all(bytes(r["payload"]).decode() == texts[r["page_id"]] for r in got if r["record_type"] == "response")
    assert all(r["payload"] is None for r in got if r["record_type"] == "revisit")


def test_archive_form(spark, pages):
    manifest = warc_dict.write_archives(pages.repartition(1), scratch_path(spark, "warc")).collect()
    assert sum(r["records"] for r in manifest) == pages.count()
    for row in manifest:
        with open(row["archive"].removeprefix("file://").removeprefix("file:"), "rb") as file:
            data = file.read()
        assert len(data) == row["bytes"]
        kind, size = struct.unpack("<II", data[:8])
        assert kind == warc_dict.DICTIONARY_FRAME
        # A reader that skips the frame and holds the dictionary gets every record by itself.
        assert len(list(warc_dict.archive_records(io.BytesIO(data)))) == row["records"]
        with pytest.raises(ValueError):
            list(warc_dict.archive_records(io.BytesIO(data[:-3])))


def test_no_pages(spark, pages):
    assert warc_dict.round_trip(spark, pages.where("false"), scratch_path(spark, "warc")).count() == 0


def test_dictionary_helps():
    samples = [warc_dict.record_bytes(i, "u", prose(i, 40).encode(), 1, "d", None, "t") for i in range(400)]
    learned = warc_dict.dictionary(samples)
    with_it = sum(len(zstandard.ZstdCompressor(dict_data=learned).compress(s)) for s in samples)
    assert with_it < 0.8 * sum(len(zstandard.ZstdCompressor().compress(s)) for s in samples)
    assert warc_dict.dictionary([]) is None and warc_dict.dictionary([b"few"]) is not None


def test_pipeline_stages(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SMALL).columns == docs.columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count()


def test_pipeline_decisions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    model = language_id.fit(docs.where(~language_id.held_out()))
    known = docs.join(language_id.predict(docs, model).where("lang_pred <> 'und'").select("doc_id"), "doc_id", "left_semi")
    copies = exact_dedup.label_copies(known).where("copies.kept").select("doc_id")
    one = known.join(copies, "doc_id", "left_semi")
    near = minhash_dedup.near_duplicates(one).where("kept")
    packed = corpus_pipeline.run(spark, SMALL)
    assert ids(packed) == ids(near)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(packed.columns)


@pytest.mark.parametrize("key", list(catalog.QUERIES))
def test_query(spark, key):
    connection = check_queries.connect(SMALL)
    verdict, _, rows = check_queries.compare(spark, connection, SMALL, key)
    # The smallest documents hold no secret; `test_secrets_of_the_sample` reads more of them.
    none = key == "op8_secret_forest" and verdict == "NO ROWS"
    assert none or (verdict in ("ok", "rows only") and rows > 0)
    assert isinstance(connection, duckdb.DuckDBPyConnection)


def test_language_stage_without_labels(spark, table):
    docs = table((1, prose(1)), (2, "12 34 !!"), (3, None), (4, ""), (5, "é"))
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 5]


def test_secrets_of_the_sample(spark):
    """Every planted token of sf0.01 stands in the result, with as many places as in the text."""
    folder = "/root/testdata/sf0.01"
    found = catalog.QUERIES["op8_secret_forest"](spark, folder).collect()
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    planted = {(r["doc_id"], m) for r in texts for m in re.findall(r"(?i)token = \"([0-9a-f]{40})\"", r["text"] or "")}
    assert planted and planted <= {(r["doc_id"], r["secret"]) for r in found}
    assert len(found) <= 1.1 * sum(len(re.findall(r"(?i)token = \"[0-9a-f]{40}\"", r["text"] or "")) for r in texts)

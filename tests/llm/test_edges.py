"""Cases that every operator defines: clashing names, null ids, repeated rows, bytes that are no UTF-8; kept trees."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import prose, rows
from triloom.llm import jaccard_join, media, mixing, pii, piece_sampling, pitman_yor, quality_cnn, suffix_dedup, token_counts

#: Names that operators make or have made, next to the columns of documents.
NAMES = ["row", "_row", "k", "_mix_size", "size", "copies", "target", "_cut_text", "kept", "_pii_terms", "terms", "id", "key", "col", "new", "of", "unit", "set", "label", "score"]


def clashing(spark, texts, ids=None):
    data = [(i, t, "en", f"s{j % 3}", None if t is None else len(t), *[f"{n}-{j}" for n in NAMES]) for j, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))


TEXTS = [None, "", "word", *[prose(60, i) for i in range(8)], prose(60, 3), "mail bob@corp.example.com or call +1 (555) 123-4567 " + prose(20, 50)]
KEEPERS = {
    "mix": mixing.mix,
    "keep_one": jaccard_join.keep_one,
    "sanitise": pii.sanitise,
    "remove_repeats": suffix_dedup.remove_repeats,
    "keep_good": lambda df: quality_cnn.keep_good(df, None),
}


@pytest.mark.parametrize("name", KEEPERS)
def test_columns_of_any_name_keep_their_values(spark, name):
    df = clashing(spark, TEXTS, [None, None, *range(2, len(TEXTS))])
    out = KEEPERS[name](df)
    assert out.columns == df.columns
    want = {r["row"]: r for r in df.collect()}
    got = out.collect()
    assert got
    for r in got:
        assert all(r[n] == want[r["row"]][n] for n in [*NAMES, "doc_id", "lang", "source"])


def test_pipeline_with_odd_rows(spark, tmp_path):
    texts = TEXTS + [prose(400, 7)] * 3 + [None, ""]
    ids = [None, None, *range(2, len(texts) - 2), 5, 5]
    clashing(spark, texts, ids).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(2, 9)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["lossless"] for r in out)


@pytest.mark.parametrize("run", [media.text_features, jaccard_join.similar_documents, suffix_dedup.repeats, token_counts.counts, pii.report, mixing.mix_report, pitman_yor.scores, lambda df: quality_cnn.score(df, None), piece_sampling.encode], ids=["op1", "op2", "op3", "op4", "op5", "op7", "op8", "op9", "op10"])
def test_null_ids_repeated_rows_and_broken_bytes(spark, run):
    data = [(None, "some words here and there", "a"), (None, None, "a"), (1, "x" * 300, None), (1, "x" * 300, None), (2, "", "b")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    broken = spark.range(3, 4).select(F.col("id").alias("doc_id"), F.expr("CAST(X'61FF62' AS STRING)").alias("text"), F.lit("b").alias("source"))
    got = run(df.union(broken)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "3", "None", "None"]
    ones = [r for r in got if r["doc_id"] == 1]
    assert ones[0] == ones[1]


def test_kept_trees_follow_edits(spark):
    texts = [None, "", "short", prose(3000, 4)]
    kept = token_counts.trees(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    edits = spark.createDataFrame([(3, 100, 120, "Don't  ", 1), (3, 9000, 9000, " 123 new", 2), (1, 0, 0, "fresh words", 1), (2, 1, 99, None, 1)], "doc_id long, start int, end int, text string, seq int")
    after = token_counts.edited(kept, edits)
    got = {r["doc_id"]: r for r in after.collect()}
    want = list(texts)
    want[3] = want[3][:100] + "Don't  " + want[3][120:]
    want[3] = want[3][:9000] + " 123 new" + want[3][9000:]
    want[1], want[2] = "fresh words", "s"
    plain = {r["doc_id"]: r for r in token_counts.counts(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")).collect()}
    for i, t in enumerate(want):
        assert "".join(x["text"] for x in got[i]["leaves"]) == (t or "")
        assert (got[i]["n_tokens"], got[i]["n_pretokens"]) == (plain[i]["n_tokens"], plain[i]["n_pretokens"])
    assert 0 < got[3]["chars_encoded"] < 2000


def test_bits_of_long_scans_take_linear_time():
    bits = media._Bits(bytes(range(256)) * 1024)
    began = time.perf_counter()
    x = [bits.take(7) for _ in range(290_000)]
    assert time.perf_counter() - began < 5
    every = np.unpackbits(np.frombuffer(bytes(range(256)) * 1024, np.uint8))[: 7 * len(x)].reshape(-1, 7)
    assert (every @ (1 << np.arange(6, -1, -1)) == x).all()


def test_further_riffs_records_and_repeated_frames():
    import struct

    one = media.pack_bytes(media.padded(b"first frame's text"))
    info = media.read_avi(one)
    frame = one[info["start"][0] : info["start"][0] + info["size"][0]]

    def chunk(tag, body):
        return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    movi = b"movi" + chunk(b"LIST", b"rec " + chunk(b"00dc", frame)) + chunk(b"00dc", b"")
    more = chunk(b"RIFF", b"AVIX" + chunk(b"LIST", movi))
    found = media.read_avi(one + more)
    frames = media.decode_frames(one + more, found)
    assert len(found["start"]) == len(info["start"]) + 2 and len(frames) == len(found["start"])
    assert (frames[-1] == frames[-2]).all() and (frames[-2] == frames[0]).all()

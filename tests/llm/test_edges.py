"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import pytest

import corpus_pipeline
from shelfwise.llm import license_windows, neighbour_vote, parity_join, patched_blocks, pfair, prefix_counts, queries, robust_outliers, stable_tree, surrogates, swap_packing
from shelfwise.session import shared_dir

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
NOTE = "Released under the MIT License."
ROWS = [
    (1, "a few plain words of a text", "en", "s", 27), (1, "a few plain words of a text", "en", "s", 27), (2, None, "en", "s", None), (3, "", "en", "s", 0),
    (4, " \n\t\x0b\x0c\r ", None, "s", 7), (5, LONG, "en", None, len(LONG)), (None, f"no id here. {NOTE}", "en", "s", 5), (6, None, None, None, None),
    (7, "x" * 30_000, "en", "t", 30_000), (8, f"mail a.b@c.example.org now {NOTE}", "en", "t", 40), (None, None, None, None, None),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["score", "block", "slot", "place", "n_entities", "row", "node", "key", "own_text", "own_row", "component_id", "weight", "first", "phase", "id", "hash",
         "sequence_id", "gone", "often", "h", "w", "t", "p", "grp", "kind", "part", "source_", "at", "none", "length"]


def table(spark, rows=ROWS, extra=True):
    if not extra:
        return spark.createDataFrame(rows, COLUMNS)
    return spark.createDataFrame([(*r, *range(len(EXTRA))) for r in rows], COLUMNS + "".join(f", {c} long" for c in EXTRA))


def labels(spark, rows=((1, 1, 0), (5, 0, 0), (5, 1, 0), (7, None, 0), (99, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def operators(spark, df, lab):
    return {
        "1": neighbour_vote.score_documents(df, lab), "2": robust_outliers.judge(df), "3": parity_join.linked_documents(df), "4": surrogates.anonymize(df, b"k"),
        "5": prefix_counts.count_report(df, queries.PIECES), "6": pfair.mixture(df), "6 rows": pfair.mix(df, ordered=True),
        "7": patched_blocks.round_trip(df, queries.WORDS), "9": swap_packing.pack_documents(df, queries.WORDS), "10": license_windows.find_notices(df),
    }


def test_odd_rows(spark):
    df = table(spark)
    got = {k: v.collect() for k, v in operators(spark, df, labels(spark)).items()}
    for k in ("1", "2", "3", "4", "5", "6", "6 rows", "7"):
        assert len(got[k]) == len(ROWS), k
        assert sorted(str(r["doc_id"]) for r in got[k]) == sorted(str(r[0]) for r in ROWS), k
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got["1"])
    assert {r["score"] for r in got["1"] if r["doc_id"] in (2, 3, 4, 6)} == {0.0}
    by = {r["doc_id"]: r for r in got["2"]}
    assert by[2]["n_words"] == by[3]["n_words"] == by[4]["n_words"] == 0 and not by[2]["kept"] and by[5]["n_words"] == 60_000
    by = {r["doc_id"]: r for r in got["3"]}
    assert [by[d]["component_id"] for d in range(1, 9)] == list(range(1, 9)) and by[2]["n_shingles"] == 0 and by[7]["n_shingles"] == 1
    assert all(r["component_id"] is None for r in got["3"] if r["doc_id"] is None)
    assert [r["text"] for r in got["4"] if r["doc_id"] in (2, 6)] == [None, None]
    assert {r["own_row"] for r in got["4"]} == {EXTRA.index("own_row")}
    assert sum(r["n_entities"] for r in got["4"]) == 1
    by = {r["doc_id"]: r for r in got["5"]}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == 0 and by[5]["over_limit"] and by[2]["n_bytes"] == 0
    assert {r["weight"] for r in got["6 rows"]} == {EXTRA.index("weight")}
    ends = sorted((r["start"], r["n_tokens"]) for r in got["7"])
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))
    assert len({(r["sequence_id"], r["offset"]) for r in got["9"]}) == len(got["9"]) and {r["doc_id"] for r in got["9"]} == {r[0] for r in ROWS}
    assert {(r["doc_id"], r["license"]) for r in got["10"]} == {(None, "mit-statement"), (8, "mit-statement")}


def test_no_rows(spark):
    for lab in (labels(spark), labels(spark).where("false")):
        for k, v in operators(spark, table(spark, []), lab).items():
            assert v.collect() == [], k


def test_no_labels(spark):
    got = {r["doc_id"]: r["score"] for r in neighbour_vote.score_documents(table(spark), labels(spark).where("false")).collect()}
    assert got[1] == 0.5 and got[3] == 0.0


def test_search_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (None, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, None]),
            (3, [0.5, 0.0]), (0, [1.0, 0.0]), (100, [1.0, 2.0, 3.0]), (4, [-1.0, 0.0]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnsRenamed({}).selectExpr("*", "1 as rank", "2 as block", "3 as score")
    got = [tuple(r) for r in stable_tree.nearest(df, "vec_id % 20 = 0", k=20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 3, 0.5), (0, 4, 4, -1.0)]
    assert stable_tree.nearest(df.where("false"), "vec_id % 20 = 0").collect() == []


@pytest.mark.parametrize("rows", [ROWS, []])
def test_stages(spark, tmp_path, rows):
    lab = labels(spark)
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    docs, full = table(spark, rows, extra=True), table(spark, rows, extra=False)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == full.columns + EXTRA, name
        path = shared_dir(spark, "stage")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if rows and name == "quality":
            assert {r["doc_id"] for r in docs.collect()} >= {1} and docs.where("doc_id in (2, 3, 4, 6)").isEmpty()
        if rows and name == "near_copies":
            assert docs.where("doc_id = 1").count() == 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in docs.collect()}

import random

import __spark_entry__ as E
import corpus_pipeline as C
from salescope.llm.common import land
from tests.llm.data import docs, empty, words


def stages(spark, d, sf_dir):
    out = []
    for name, stage in C.STAGES:
        d = land(stage(spark, d, sf_dir), f"test-{name}")
        out.append(d)
    return out


def bench(spark, folder, rows):
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_keep_clean_documents_and_drop_what_they_reject(spark, tmpdir_path):
    d = docs(spark)
    passage = " ".join(words(d.filter("doc_id = 7").first()["text"])[:20])
    bench(spark, tmpdir_path, [(1, passage)])
    out = stages(spark, d, tmpdir_path)
    for x in out[:-1]:
        assert x.columns == d.columns
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in out]
    n = {r["doc_id"]: r["text"] for r in d.collect()}
    assert ids[0] == {i for i, t in n.items() if t and any(c.isalpha() for c in t)}
    assert 61 not in ids[1] or 1 not in ids[1]
    assert ids[1] - ids[2] and 7 not in ids[2]
    assert ids[3] <= ids[2] and out[4].count() == out[3].count()
    assert sorted(r["shard"] for r in out[4].select("shard").distinct().collect())[-1] <= 15


def test_stages_judge_rows_with_null_and_repeated_ids_by_their_own_texts(spark, tmpdir_path):
    other = [f"{w} rivers run past old mills and over stones near {w} towns" for w in ("seven", "cold", "broad", "green")]
    copy = "a copy that was taken from the very first document of this table"
    passage = "the benchmark asks which of these four answers is the right one here today"
    rows = [(None, other[0], "a"), (None, other[1], "b"), (8, other[2], "c"), (8, other[3], "d"),
            (1, copy, "e"), (9, copy, "f"), (9, "nine has another text that nobody else wrote down", "g"),
            (None, passage, "h"), (8, passage + " once more", "i"), (None, "a group of copies without any id at all", "j"),
            (None, "a group of copies without any id at all", "k"), (None, None, "l"), (None, "", "m")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bench(spark, tmpdir_path, [(1, passage)])
    unique = C.near_dedup(spark, d, tmpdir_path)
    names = sorted(r["source"] for r in unique.collect())
    assert unique.columns == d.columns
    assert names in (sorted("abcdeg" + x + y + "lm") for x in ("h", "i", "hi") for y in "jk")
    clean = sorted(r["source"] for r in C.decontamination(spark, d, tmpdir_path).collect())
    assert clean == list("abcdefgjklm")


def test_language_id_drops_by_its_prediction(spark, tmpdir_path, monkeypatch):
    rng = random.Random(6)
    syllables = {"en": ["the", "ing", "th", "wh"], "de": ["sch", "ung", "ei", "ver"], "fr": ["eau", "ou", "que", "tion"], "es": ["ez", "lla", "cio", "na"]}
    text = lambda p: " ".join("".join(rng.choice(p) for _ in range(3)) for _ in range(30))
    rows = [(i, text(p), lang if i % 7 else None) for i, (lang, p) in enumerate([*syllables.items()] * 40)]
    # labels of these are wrong: the text decides
    rows += [(1000, text(syllables["de"]), "en"), (1001, text(syllables["en"]), None), (1002, "xyxxy yyxyx xxyxy " * 9, None), (1003, None, "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in C.language_id(spark, d, tmpdir_path).collect()}
    assert kept == {r[0] for r in rows} - {1002, 1003}  # no learned language is like 1002
    monkeypatch.setattr(C, "LANGUAGES", ["en"])
    out = C.language_id(spark, d, tmpdir_path)
    assert out.columns == d.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert kept == {i for i in range(160) if i % 4 == 0} | {1001}


def test_pipeline_of_an_empty_table(spark, tmpdir_path):
    bench(spark, tmpdir_path, [])
    assert [x.count() for x in stages(spark, empty(spark), tmpdir_path)] == [0] * 5


def test_all_queries_are_registered():
    names = set(E.queries())
    assert "pipeline" in names
    assert all(any(q.startswith(f"op{i}_") for q in names) for i in range(1, 14))

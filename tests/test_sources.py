import json

import pytest

from spanforge.sources import corpora, tables


def write(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")
    return str(path)


def test_documents_last_text_first_place(spark, tmp_path):
    p = write(tmp_path / "d.jsonl", [{"id": 1, "text": "one"}, "", {"id": "2", "text": "two"}, {"id": "1", "text": "uno", "meta": {"x": 1}}])
    got = [tuple(r) for r in tables.load_documents(spark, p).orderBy("doc_pos").select("id", "text").collect()]
    assert got == [("1", "uno"), ("2", "two")]


@pytest.mark.parametrize("line", ["{not json", '{"text": "no id"}', "[1]"])
def test_bad_lines_are_named(spark, tmp_path, line):
    p = write(tmp_path / "d.jsonl", [{"id": "1", "text": "x"}, line])
    with pytest.raises(ValueError, match="d.jsonl:2"):
        tables.load_documents(spark, p)


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.load_documents(spark, str(tmp_path / "none.jsonl"))


def test_round_trip_through_strict_loader(spark, tmp_path):
    c = corpora.realistic(spark)
    docs, queries = tables.DatasetImport(c.documents, c.queries, {}).write_jsonl(str(tmp_path))
    loaded = tables.load_documents(spark, docs)
    q = tables.load_queries(spark, queries, loaded)
    assert loaded.count() == 27 and q.count() == 18
    assert sorted(r["gold"] for r in q.collect()) == sorted(r["gold"] for r in c.queries.collect())


def test_authoring_file(spark, tmp_path):
    docs = tables.load_documents(spark, write(tmp_path / "d.jsonl", [{"id": "a", "text": "red fox runs"}, {"id": "b", "text": "blue fox sits"}]))
    spec = [
        {"id": "q1", "text": "t", "source_id": "a", "answer": "fox"}, {"id": "q2", "text": "t", "source_id": "a", "answer_all": ["red", "runs"]},
        {"id": "q3", "text": "t", "alternatives": [{"source_id": "a", "answer": "red"}, {"source_id": "b", "answer": "blue"}]},
    ]
    got = {r["query_id"]: r["gold"] for r in tables.load_authoring(spark, write(tmp_path / "s.jsonl", spec), docs).collect()}
    span = got["q1"].alternatives[0].required_spans[0]
    assert (span.start, span.end, span.quoted_text) == (4, 7, "fox")
    assert [len(a.required_spans) for a in got["q2"].alternatives] == [2] and len(got["q3"].alternatives) == 2
    with pytest.raises(ValueError, match="quote_not_found"):
        tables.load_authoring(spark, write(tmp_path / "t.jsonl", [{"id": "q", "text": "t", "source_id": "a", "answer": "cat"}]), docs)


def squad(wrapped=True):
    context = "Cats sleep. Dogs bark."
    articles = [
        {"title": "A", "paragraphs": [{"context": context, "qas": [
            {"id": "1", "question": "who sleeps", "answers": [{"text": "Cats", "answer_start": 0}, {"text": "Cats", "answer_start": 0}, {"text": "Dogs", "answer_start": 12}]},
            {"id": "2", "question": "impossible", "is_impossible": True, "answers": []}, {"id": "3", "question": "none", "answers": []},
            {"id": "4", "question": "wrong", "answers": [{"text": "Cows", "answer_start": 0}]}]}]},
        {"title": "B", "paragraphs": [{"context": context, "qas": []}, {"context": "Birds sing.", "qas": [{"id": "5", "question": "who sings", "answers": [{"text": "Birds", "answer_start": 0}]}]}]},
    ]
    return json.dumps({"data": articles} if wrapped else articles)


@pytest.mark.parametrize("wrapped", [True, False])
def test_squad(spark, tmp_path, wrapped):
    p = tmp_path / "s.json"
    p.write_text(squad(wrapped))
    imp = tables.load_squad(spark, str(p))
    assert imp.skipped == {"impossible": 1, "no_answer": 1, "unverified": 1}
    assert {r["title"] for r in imp.documents.collect()} == {"A", "B"} and imp.documents.count() == 2
    q = {r["query_id"]: r["gold"] for r in imp.queries.collect()}
    import hashlib

    versions = {a.required_spans[0].source_version for g in q.values() for a in g.alternatives}
    assert versions == {hashlib.sha256(x.encode()).hexdigest() for x in ("Cats sleep. Dogs bark.", "Birds sing.")}
    assert set(q) == {"1", "5"} and [a.required_spans[0].start for a in q["1"].alternatives] == [0, 12]
    one = tables.load_squad(spark, str(p), max_queries=1, max_answers=1)
    assert one.documents.count() == 1 and [len(r["gold"].alternatives) for r in one.queries.collect()] == [1]
    docs, queries = imp.write_jsonl(str(tmp_path / "out"))
    assert tables.load_queries(spark, queries, tables.load_documents(spark, docs)).count() == 2
    assert [json.loads(x)["meta"] for x in open(docs)] == [{"title": "A"}, {"title": "B"}] and {json.loads(x)["meta"]["dataset"] for x in open(queries)} == {"squad"}


def test_beir(spark, tmp_path):
    corpus = write(tmp_path / "c.jsonl", [{"_id": "d1", "title": " T ", "text": " body "}, {"_id": "d2", "title": "", "text": "plain"}, {"_id": "d3", "title": "", "text": ""}, {"_id": "d4", "title": "x", "text": "distractor"}])
    queries = write(tmp_path / "q.jsonl", [{"_id": "q1", "text": "one"}, {"_id": "q2", "text": "two"}])
    qrels = tmp_path / "r.tsv"
    qrels.write_text("query-id\tcorpus-id\tscore\nq2\td3\t1\nq1\td2\t1\nq1\td1\t2\nq1\td2\t1\nq1\td4\t0\nq9\td1\t1\nshort\n")
    imp = tables.load_beir(spark, corpus, queries, str(qrels))
    assert imp.documents.count() == 4 and imp.skipped == {"unknown_query": 1, "no_relevant": 1}
    r = imp.queries.first()
    assert r["query_id"] == "q1" and [a.required_spans[0].quoted_text for a in r["gold"].alternatives] == ["plain", "T\n\nbody"]
    assert "unknown_query=1" in imp.summary()


def test_beir_counts_and_orders_by_judgements_that_are_left(spark, tmp_path):
    corpus = write(tmp_path / "c.jsonl", [{"_id": "d1", "title": "", "text": "one"}, {"_id": "d2", "title": "", "text": "two"}, {"_id": "d3", "title": "", "text": ""}])
    queries = write(tmp_path / "q.jsonl", [{"_id": q, "text": q} for q in ("q1", "q2", "q3", "q4")])
    qrels = tmp_path / "r.tsv"
    judged = lambda *rows: qrels.write_text("query-id\tcorpus-id\tscore\n" + "".join(f"{q}\t{d}\t{n}\n" for q, d, n in rows))
    judged(("q1", "d1", 0), ("q2", "d2", 1), ("q1", "d1", 1), ("q3", "d1", 0), ("q9", "d1", 0))
    imp = tables.load_beir(spark, corpus, queries, str(qrels))
    assert imp.skipped == {"no_relevant": 0, "unknown_query": 0}
    assert [r["query_id"] for r in imp.queries.orderBy("query_pos").collect()] == ["q2", "q1"]
    judged(("q9", "d1", 1), ("q1", "d1", 1), ("q4", "d3", 1), ("q8", "d1", 1), ("q2", "d2", 1))
    for most, kept, skipped in ((1, ["q1"], (0, 1)), (2, ["q1", "q2"], (1, 2)), (3, ["q1", "q2"], (1, 2)), (None, ["q1", "q2"], (1, 2))):
        imp = tables.load_beir(spark, corpus, queries, str(qrels), max_queries=most)
        assert [r["query_id"] for r in imp.queries.orderBy("query_pos").collect()] == kept
        assert (imp.skipped["no_relevant"], imp.skipped["unknown_query"]) == skipped


def test_planted_needles(spark):
    c, _ = corpora.planted(spark, "representation")
    r = corpora.span_in(c.documents, "d", "hidden").first()
    assert r["end"] - r["start"] == 6 and corpora.span_in(c.documents, "d", "zzz").first()["start"] == -1

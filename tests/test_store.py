import gzip
import json

import pytest
from pyspark.sql import functions as F

from tokenloom import ingest as cli
from tokenloom.errors import BackendError, EngineError, InvalidDocument, SchemaMismatch
from tokenloom.operators import match
from tokenloom.schema import SENTENCES
from tokenloom.sources import annotated, objects
from tokenloom.sources.store import Store, batch_hash
from tokenloom.streaming import ingest


def token_field(name, tokens):
    return {"$type": "any.name.TokensField", "name": name, "tokens": tokens}


def graph_field(edges, roots=(), name="dependencies"):
    return {"$type": "any.name.GraphField", "name": name, "edges": edges, "roots": list(roots)}


def document(i, *sentences):
    return json.dumps({"id": f"d{i}", "metadata": [{"k": [1, "x"]}, None], "sentences": [{"numTokens": n, "fields": list(fields)} for n, *fields in sentences]})


def painter(i=1):
    return document(i, (5, token_field("word", "Maria paints two houses !".split()), token_field("tag", "PROPN VERB NUM NOUN PUNCT".split()), token_field("other", ["x"]), graph_field([[1, 0, "agent"], [3, 2, "number"], [1, 3, "object"], [1, 3, "goal"]], [1])), (1, token_field("word", ["a|b"])))


BAD = {
    "not JSON": "{", "no object": "[1]", "no id": '{"sentences": []}', "no sentences": '{"id": "x"}',
    "short field": document(1, (2, token_field("word", ["a"]))), "no word": document(1, (1, token_field("tag", ["a"]))), "null token": document(1, (1, token_field("word", [None]))),
    "edge outside": document(1, (1, token_field("word", ["a"]), graph_field([[0, 1, "x"]]))), "edge of two": document(1, (1, token_field("word", ["a"]), graph_field([[0, 0]]))), "edge not a number": document(1, (1, token_field("word", ["a"]), graph_field([["q", 0, "x"]]))),
    "root outside": document(1, (1, token_field("word", ["a"]), graph_field([], [1]))), "unknown type": document(1, (1, token_field("word", ["a"]), {"$type": "Other", "name": "x"})), "negative root": document(1, (1, token_field("word", ["a"]), graph_field([], [-1]))),
}


def test_flatten(spark):
    rows = annotated.sentences_of_json(spark, painter(), document(2, (3, token_field("word", ["x", "", "z"]), graph_field([[0, 2, "a,b"]], [0], "dependencies_basic")))).orderBy("sent_ord").collect()
    a, b, c = rows
    assert (a.doc_id, a.sentence_id, a.sentence_length, a.word, a.tag, a.lemma) == ("d1", "d1_0", 5, ["Maria", "paints", "two", "houses", "!"], ["PROPN", "VERB", "NUM", "NOUN", "PUNCT"], None)
    assert a.outgoing_edges == [[], ["agent", "goal", "object"], [], ["number"], []] and a.incoming_edges == [["agent"], ["root"], ["number"], ["goal", "object"], []] and a.graph.name == "dependencies" and a.graph_basic is None
    assert (b.sentence_id, b.word, b.graph, b.outgoing_edges) == ("d1_1", ["a|b"], None, [])
    assert c.graph is None and c.graph_basic.edges[0].rel == "a,b" and c.incoming_edges == [["root"], [], ["a,b"]] and a.sent_ord < b.sent_ord < c.sent_ord
    assert [f.name for f in annotated.sentences_of_json(spark, painter()).schema] == [f.name for f in SENTENCES]


@pytest.mark.parametrize("kind", BAD)
def test_unsound_documents(spark, kind):
    with pytest.raises(InvalidDocument):
        annotated.sentences_of_json(spark, painter(), BAD[kind])


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for i in range(7):
        (tmp_path / f"in/{i}.json").write_text(painter(i))
    with gzip.open(tmp_path / "in/sub/8.JSON.gz", "wt") as f:
        f.write(painter(8))
    (tmp_path / "in/note.txt").write_text("no")
    (tmp_path / "in/9.json").write_text(BAD["short field"])
    return tmp_path


def test_files_are_listed_in_order(spark, folder):
    names = [p.rsplit("/", 1)[1] for p in annotated.list_files(spark, str(folder / "in"))]
    assert names == [*[f"{i}.json" for i in range(7)], "9.json", "8.JSON.gz"]
    assert len(annotated.list_files(spark, str(folder / "in"), 3)) == 3
    assert annotated.read_files(spark, str(folder / "in")).count() == 9


def test_batches_are_taken_once(spark, folder):
    store = Store(spark, str(folder / "table"))
    with pytest.raises(InvalidDocument):
        store.add_folder(str(folder / "in"))
    assert store.sentences().count() == 0
    stats = store.add_folder(str(folder / "in"), batch_docs=4, policy="skip")
    assert (stats.documents, stats.sentences, stats.rejected, stats.batches) == (8, 16, 1, 3) and "numTokens" in stats.errors[0][1]
    again = store.add_folder(str(folder / "in"), batch_docs=4, policy="skip")
    assert (again.batches, again.known_batches) == (0, 3) and store.sentences().count() == 16
    assert store.summary().splits == 3 and store.summary().sentences == 16 and store.summary().bytes > 0
    assert spark.read.parquet(f"{store.path}/rejects").count() == 1
    assert match.count(store.sentences(), "[tag=VERB] >agent [word=Maria]") == 8
    (folder / "table/data/half").mkdir()  # a run that died
    assert store.sentences().count() == 16
    order = [r[0] for r in store.sentences().orderBy("split_id", "sent_ord").select("sentence_id").collect()]
    assert store.compact() == 3 and store.summary().splits == 1
    assert [r[0] for r in store.sentences().orderBy("split_id", "sent_ord").select("sentence_id").collect()] == order
    assert store.add_folder(str(folder / "in"), batch_docs=4, policy="skip").known_batches == 3
    report = store.collect_garbage(grace_s=0, staged_grace_s=-1, dry_run=True)
    assert len(report.removed) == 4 and report.dry_run and store.collect_garbage(0, -1).removed == report.removed
    assert store.sentences().count() == 16 and store.collect_garbage(0, -1).removed == () and store.compact() == 0
    assert store.drop() and not store.drop()


def test_other_columns_are_an_error(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    store.ensure()
    store.ensure()
    (tmp_path / "t/schema.json").write_text("{}")
    (tmp_path / "t/.schema.json.crc").unlink(missing_ok=True)
    with pytest.raises(SchemaMismatch):
        store.add_sentences(spark.createDataFrame([], SENTENCES))
    with pytest.raises(EngineError):
        Store(spark, str(tmp_path / "u")).add_documents(spark.createDataFrame([], "path string, value string"), "perhaps")


def test_one_path_twice_is_an_error(spark, tmp_path):
    with pytest.raises(EngineError):
        Store(spark, str(tmp_path / "t")).add_documents(spark.createDataFrame([("a", painter(1)), ("a", painter(2))], "path string, value string"))


def test_rows_can_be_added_as_they_are(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    rows = annotated.sentences_of_json(spark, painter()).withColumn("stray", F.lit(1)).drop("lemma")
    assert store.add_sentences(rows.limit(0)).batches == 0
    assert store.add_sentences(rows, "x").sentences == 2 and store.add_sentences(rows, "x").known_batches == 1
    assert store.sentences().columns == [f.name for f in SENTENCES] and store.sentences().count() == 2


def test_batch_hash_knows_order_and_content(spark):
    h = lambda rows: batch_hash(spark.createDataFrame(rows, "path string, value string").repartition(3), "path")
    one = h([("a", "x"), ("b", "y")])
    assert one == h([("b", "y"), ("a", "x")]) == h([("c", "x"), ("d", "y")]) and one != h([("a", "y"), ("b", "x")]) and one != h([("a", "xy"), ("b", "")]) and one.startswith("sha256-") and len(one) == 39


def test_stream_is_the_batch(spark, folder):
    batch, stream = Store(spark, str(folder / "a")), Store(spark, str(folder / "b"))
    batch.add_folder(str(folder / "in"), policy="skip")
    seen = []
    ingest.start(stream, str(folder / "in"), str(folder / "cp"), files_per_trigger=2, seen=seen.append).awaitTermination()
    ids = lambda s: sorted(r[0] for r in s.sentences().select("sentence_id").collect())
    assert ids(stream) == ids(batch) and len(seen) == 5
    (folder / "in/more.json").write_text(painter(50))
    ingest.start(stream, str(folder / "in"), str(folder / "cp"), files_per_trigger=2).awaitTermination()
    assert len(ids(stream)) == len(ids(batch)) + 2
    query = ingest.start(stream, str(folder / "in"), str(folder / "cp"), once=False)
    ingest.stop(query)
    assert not query.isActive and len(ids(stream)) == len(ids(batch)) + 2


def test_command_line(spark, folder, capsys):
    table = str(folder / "t")
    assert cli.main([str(folder / "in"), table], spark) == 1
    assert cli.main([str(folder / "in"), table, "--skip-invalid", "--batch-docs", "3", "--compact", "--gc", "--gc-grace", "0"], spark) == 2
    assert "splits merged" in capsys.readouterr().out
    assert cli.main([str(folder / "in"), table, "--limit", "2", "--recreate"], spark) == 0
    assert Store(spark, table).sentences().count() == 4


def test_object_store_settings(spark, tmp_path):
    env = {"S3_ENDPOINT": "http://localhost:9", "S3_BUCKET": "b", "AWS_ACCESS_KEY_ID": "key", "AWS_SECRET_ACCESS_KEY": "secret"}
    s = objects.ObjectStore.from_env(env)
    assert "secret" not in repr(s) and "key" not in repr(s).replace("key=", "") and s.conf()["fs.s3a.bucket.b.path.style.access"] == "true" and s.connect(spark) == "s3a://b"
    with pytest.raises(BackendError):
        objects.ObjectStore.from_env({})
    assert objects.ping(spark, str(tmp_path)).startswith(b"ping ") and not list(tmp_path.glob("ping*"))


def test_lanes_take_batches_at_once_and_keep_their_order(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "lanes"))
    (folder / "in/bad.json").write_text("{")
    stats = store.add_folder(str(folder / "in"), batch_docs=2, policy="skip", lanes=3)
    assert (stats.lanes, stats.stopped, stats.rejected) == (3, 0, 2) and stats.batches == stats.splits == -(-(stats.documents + stats.rejected) // 2)
    rows = store.sentences().orderBy("split_id", "sent_ord").collect()
    one = Store(spark, str(tmp_path / "one"))
    one.add_folder(str(folder / "in"), batch_docs=2, policy="skip")
    assert [r.doc_id for r in rows] == [r.doc_id for r in one.sentences().orderBy("split_id", "sent_ord").collect()]
    assert store.add_folder(str(folder / "in"), batch_docs=2, policy="skip", lanes=2).known_batches == stats.batches
    with pytest.raises(InvalidDocument):
        Store(spark, str(tmp_path / "failing")).add_folder(str(folder / "in"), batch_docs=2, lanes=2)


def test_a_stopped_run_is_resumed(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    first = store.add_folder(str(folder / "in"), batch_docs=2, policy="skip", stop=lambda: store.ledger().count() >= 1)
    again = store.add_folder(str(folder / "in"), batch_docs=2, policy="skip")
    assert first.batches == again.known_batches >= 1 and first.stopped and again.batches >= 1 and store.summary().sentences == first.sentences + again.sentences


def test_two_writers_take_different_splits(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "t")), Store(spark, str(tmp_path / "t"))
    a.ensure()
    assert [a._next_split(), b._next_split(), a._next_split()] == [1, 2, 3] and not b._claim(2)


def test_an_indexed_store_is_searched_split_by_split(spark, tmp_path):
    from tokenloom.operators.search import Searcher, SearchQuery, StoreSearcher

    store = Store(spark, str(tmp_path / "t"), ("word", "tag", "outgoing_edges", "incoming_edges"))
    for k in range(4):
        docs = [document(f"{k}x{i}", (3, token_field("word", ["a", "b", f"w{k}"]), token_field("tag", ["A", "B", "C"]), graph_field([[0, 1, "x"], [1, 2, f"r{k}"]], [0]))) for i in range(5)]
        assert store.add_sentences(annotated.sentences_of_json(spark, *docs)).indexed_batches == 1
    searcher, plain = StoreSearcher(store), Searcher(store.sentences)
    for query in ("a", "[word=/w[12]/]", "[tag=B] >r2 [word=w2]", "[tag!=A]"):
        cursor = None
        for _ in range(2):
            one, other = (s.search(SearchQuery(query, 3, cursor, True)) for s in (searcher, plain))
            assert (one.hits, one.total_hits, one.next_cursor) == (other.hits, other.total_hits, other.next_cursor)
            if (cursor := one.next_cursor) is None:
                break
    searcher.search(SearchQuery("a", 3))
    assert len(searcher.read) == 1  # the page was full after the first split
    searcher.search(SearchQuery("[word=w3]", 3))
    assert searcher.read == [4]  # the others lack the word
    assert store.build_index() == 0 and store.compact(target=1 << 40) == 4 and store.postings() is not None
    plain_store = Store(spark, str(tmp_path / "t2"))
    plain_store.add_sentences(store.sentences())
    assert plain_store.postings() is None and StoreSearcher(plain_store).search("a").total_hits == 20
    plain_store.index = store.index
    assert plain_store.build_index() == 1 and plain_store.postings().count() == store.postings().count()

import json
import os

from quillforge.streaming import text as S


def stream(spark, tmp_path, schema, batches):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, rows in enumerate(batches):
        path = folder / f"{k}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # batches come in the order of the files' times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def test_tokens_of_a_stream(spark, tmp_path):
    lines = stream(spark, tmp_path, "text string", [[{"text": "The cats"}], [{"text": "A dog"}]])
    got = run(S.tokenize_stream(lines, stem=False).select("toks"), "toks", "append", tmp_path)
    assert sorted(got) == [(["cats"],), (["dog"],)]


def test_running_document_frequencies(spark, tmp_path):
    lines = stream(spark, tmp_path, "toks array<string>", [[{"toks": ["a", "a"]}], [{"toks": ["a", "b"]}]])
    got = run(S.document_frequency_stream(lines), "dfs", "complete", tmp_path)
    assert set(got) == {("a", 2), ("b", 1), ("#eol", 2)}


def test_runs_across_batches(spark, tmp_path):
    row = lambda i, k, t: {"source": "s", "line_id": i, "key": k, "toks": [t]}
    lines = stream(spark, tmp_path, "source string, line_id long, key string, toks array<string>", [[row(0, "d1:1", "a"), row(1, "d1:2", "b")], [row(2, "d1:3", "c"), row(3, "d2:1", "e")]])
    got = run(S.merge_stream(lines), "runs", "append", tmp_path)
    assert sorted(got, key=lambda r: r[3]) == [("s", "d1", True, ["a"]), ("s", "d1", False, ["b"]), ("s", "d1", False, ["c"]), ("s", "d2", True, ["e"])]


def test_compile_and_query_streams_equal_the_batch_forms(spark, tmp_path):
    from quillforge.operators import docfreq, retrieve

    docs = spark.createDataFrame([("d1", ["x", "x", "y"]), ("d2", ["y", "z"])], "docno string, toks array<string>")
    df = docfreq.document_frequency(docs)
    rows = spark.createDataFrame([(i, t.split()) for i, t in enumerate(("x y", "z z q", "", "y"))], "line_id long, toks array<string>")
    topics = spark.createDataFrame([(1, ["x"], [1.0]), (2, ["y", "z"], [1.0, 3.0])], "topic int, terms array<string>, weights array<double>")
    index = retrieve.build_index(docs)

    def ran(table, make):
        path, found = str(tmp_path / f"in{len(table.columns)}"), []
        table.repartition(2).write.parquet(path)
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
        query = make(stream, lambda out, _: found.extend(out.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(map(repr, found))

    got = ran(rows, lambda s, sink: S.compile_stream(s, df, sink, norm="l2"))
    assert got == sorted(map(repr, docfreq.idf_vectors(rows, df, norm="l2").collect()))
    got = ran(topics, lambda s, sink: S.query_stream(s, index, sink, weighted=True))
    assert got == sorted(map(repr, retrieve.retrieve(index, topics, weighted=True).collect()))

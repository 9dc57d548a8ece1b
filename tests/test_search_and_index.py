from __future__ import annotations

from pyspark.sql import functions as F

from folioloom.operators import citations as ct
from folioloom.operators import figures as fg
from folioloom.operators import index as ix
from folioloom.operators import metadata as md
from folioloom.operators import retrieval as rt
from folioloom.sources import records
from folioloom.sources.providers import HashEmbedder, OverlapReranker, PlainReader
from folioloom.streaming import ingest

DOCS = "doc_id string, source_filename string, title string, author string, year int, publication string, document_type string, language string"
CHUNKS = "chunk_id string, doc_id string, text string, start_page int, end_page int, section_heading string, embedding array<float>"


def corpus(spark):
    docs = spark.createDataFrame([("d1", "a (2001).pdf", "Tin mining", "Azmi Khalid, A.", 1950, "Journal of the Malaysian Branch of the Royal Asiatic Society", "index", "en"), ("d2", "b.pdf", "Rubber", None, None, "Other", "obituary", "ms")], DOCS)
    chunks = spark.createDataFrame([("c1", "d1", "tin and more tin", 1, 1, None, [1.0, 0.0]), ("c2", "d1", "rubber", 2, 3, "H", [0.9, 0.1]), ("c3", "d2", "tin rubber", 1, 2, None, [0.0, 1.0]), ("c4", "d2", "nothing", 5, 5, None, None)], CHUNKS)
    return chunks, docs


def test_filters_exclude_nulls_and_unset_ones_vanish(spark):
    _, docs = corpus(spark)
    assert rt.Filters().apply(docs).count() == 2
    assert [r["doc_id"] for r in rt.Filters(year_to=3000).apply(docs).collect()] == ["d1"]
    assert rt.Filters(year_from=3000).apply(docs).count() == 0
    assert [r["doc_id"] for r in rt.Filters(publication="jmbras").apply(docs).collect()] == ["d1"]
    assert [r["doc_id"] for r in rt.Filters(author="Khalid, Azmi").apply(docs).collect()] == ["d1"]
    assert rt.Filters(source_filename="B.PDF").apply(docs).count() == 1


def test_nearest_and_rank(spark):
    chunks, _ = corpus(spark)
    assert [(r["chunk_id"], r["vrank"]) for r in rt.nearest(chunks, [1.0, 0.0], 2).collect()] == [("c1", 1), ("c2", 2)]
    assert rt.target_rank(chunks.filter("embedding IS NOT NULL"), [1.0, 0.0], "c3").first()["rank"] == 3


def test_text_search_falls_back(spark):
    chunks, _ = corpus(spark)
    assert [r["chunk_id"] for r in rt.text_search(chunks, "tin rubber", 5, least=1).collect()] == ["c3"]
    assert {r["chunk_id"] for r in rt.text_search(chunks, "tin rubber", 5).collect()} == {"c1", "c2", "c3"}
    assert rt.text_search(chunks, "of the", 5).count() == 0
    index = rt.postings(chunks)
    for query in ("tin rubber", "tin", "nothing more"):
        assert rt.text_search(chunks, query, 5, index=index).collect() == rt.text_search(chunks, query, 5).collect()


def test_retrieve_caps_and_reranks(spark):
    chunks, docs = corpus(spark)
    rows = rt.retrieve(chunks, docs, "tin", [1.0, 0.0], 3, per_doc=1).collect()
    assert sorted(r["doc_id"] for r in rows) == ["d1", "d2"] and rows[0]["chunk_id"] == "c1"
    kept = rt.retrieve(chunks, docs, "tin", [1.0, 0.0], 4, rerank=OverlapReranker(), threshold=0.5).collect()
    assert {r["chunk_id"] for r in kept} == {"c1", "c2", "c3"}
    assert all(r["doc_id"] == "d2" for r in rt.retrieve(chunks, docs, "tin", [1.0, 0.0], 4, rt.Filters(language="ms")).collect())


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "chunk_id string, vrank int")
    b = spark.createDataFrame([("y", 1), ("x", 2)], "chunk_id string, trank int")
    s = {r["chunk_id"]: r["score"] for r in rt.fuse(a, b, 5).collect()}
    assert abs(s["x"] - s["y"]) < 1e-12 and abs(s["x"] - (1 / 61 + 1 / 62)) < 1e-12


def test_contextual_figures(spark):
    chunks, _ = corpus(spark)
    figs = spark.createDataFrame([("f1", "d1", 3, "a map"), ("f2", "d1", 3, "Figure on p.3"), ("f3", "d2", 9, "x")], "figure_id string, doc_id string, page_num int, caption string")
    assert [(r["chunk_id"], r["figure_id"]) for r in rt.contextual_figures(chunks, figs).collect()] == [("c2", "f1")]


def test_upsert_and_reuse(spark):
    old = spark.createDataFrame([("a", "A", 1, ["k"]), ("b", "B", 2, ["k"])], "doc_id string, title string, year int, keywords array<string>")
    new = spark.createDataFrame([("b", None, 3, []), ("c", "C", None, ["n"])], "doc_id string, title string, year int, keywords array<string>")
    assert {tuple(r[:3]) + (tuple(r[3]),) for r in ix.upsert_documents(old, new).collect()} == {("a", "A", 1, ("k",)), ("b", "B", 3, ("k",)), ("c", "C", None, ("n",))}
    chunks, _ = corpus(spark)
    again = ix.embed_reuse(chunks, chunks.drop("embedding"))
    assert again.filter("needs_embedding").count() == 1  # the one that had no vector
    changed = ix.embed_reuse(chunks, chunks.drop("embedding").withColumn("text", F.concat("text", F.lit("!"))))
    assert ix.embed_missing(changed, HashEmbedder(8).column(F.col("text"))).filter("size(embedding) = 8").count() == 4


def test_audit_and_diff(spark):
    chunks, _ = corpus(spark)
    same = ix.chunk_audit(chunks, chunks).collect()
    assert all(r["unchanged"] == r["total_chunks"] and not r["added"] + r["removed"] + r["text_changed"] for r in same)
    old = spark.createDataFrame([("d", "x", 1, 0, "a"), ("d", "y", 1, 1, "b")], "doc_id string, block_id string, page_num_1 int, reading_order int, text_raw string")
    new = spark.createDataFrame([("d", "x", 1, 0, "A"), ("d", "z", 1, 1, "c")], old.schema)
    r = ix.diff_totals(ix.block_diff(old, new)).first()
    assert (r["added"], r["removed"], r["changed"], r["unchanged"]) == (1, 1, 1, 0)


def test_edits_and_overlays(spark):
    docs = spark.createDataFrame([("a", "A", 1, ["k"]), ("b", "B", 2, ["k"])], "doc_id string, title string, year int, keywords array<string>")
    edits = spark.createDataFrame([("a", {"title": None, "year": "x", "keywords": "p, q"})], "doc_id string, fields map<string,string>")
    got = {r["doc_id"]: (r["title"], r["year"], r["keywords"]) for r in ix.edit_metadata(docs, edits).collect()}
    assert got == {"a": (None, None, ["p", "q"]), "b": ("B", 2, ["k"])}
    base = spark.createDataFrame([("a", '{"t": 1, "u": 2}'), ("b", '{"t": 1}')], "doc_id string, json string")
    over = spark.createDataFrame([("a", '{"t": null}')], "doc_id string, json string")
    assert {r["doc_id"]: r["json"] for r in ix.overlay(base, over).collect()} == {"a": '{"t": null, "u": 2}', "b": '{"t": 1}'}


def test_replace_and_delete(spark):
    chunks, docs = corpus(spark)
    new = chunks.filter("chunk_id = 'c1'").withColumn("text", F.lit("new"))
    assert sorted(r["chunk_id"] for r in ix.replace_chunks(chunks, new).collect()) == ["c1", "c3", "c4"]
    status = docs.select(F.col("source_filename").alias("filename"))
    left = ix.delete_documents({"documents": docs, "chunks": chunks, "pipeline_status": status}, docs.filter("doc_id = 'd1'"))
    assert [left[t].count() for t in ("documents", "chunks", "pipeline_status")] == [1, 2, 1]


def test_citations(spark):
    df = spark.createDataFrame([("a", "See [5] and [3, 5] then [9]")], "answer_id string, text string")
    assert df.select(ct.cited_set(F.col("text"))).first()[0] == [3, 5, 9]
    m = ct.index_map(df)
    assert {(r["old"], r["new"]) for r in m.collect()} == {(5, 1), (3, 2), (9, 3)}
    src = spark.createDataFrame([("a", 3, "d", 1), ("a", 5, "d", 1)], "answer_id string, position int, doc_id string, start_page int")
    c = ct.collapse(m, src)
    assert {(r["old"], r["new"]) for r in c.collect()} == {(5, 1), (3, 1), (9, 2)}
    pairs = c.groupBy("answer_id").agg(F.collect_list(F.struct("old", "new")).alias("m"))
    assert df.join(pairs, "answer_id").select(ct.renumber("text", "m")).first()[0] == "See [1] and [1, 1] then [2]"
    t = spark.createDataFrame([("x" * 50 + "\n\n**Sources:**\n[1] y",), ("a\nSources:\n" + "x" * 50,), ("The sources say",)], "t string")
    assert [r[0] for r in t.select(ct.strip_sources(F.col("t"))).collect()] == ["x" * 50, "a\nSources:\n" + "x" * 50, "The sources say"]


def test_context_and_lines(spark):
    chunks, docs = corpus(spark)
    rows = chunks.drop("embedding").join(docs, "doc_id").withColumn("score", F.lit(1.0))
    heads = {r["chunk_id"]: r["block"].split("\n")[0] for r in ct.context_blocks(rows).collect()}
    assert heads["c1"] == '[1] [Index] Azmi Khalid, A. (2001), "Tin mining", p.1'
    assert heads["c3"] == "[3] [Obituary] Rubber, pp.1-2"
    line = rows.filter("chunk_id = 'c2'").select(ct.citation_line(F.lit(2))).first()[0]
    assert line == "[2] Azmi Khalid, A. (1950). 'Tin mining', *JMBRAS*, pp. 2–3"


def test_figures(spark):
    box = lambda a, b, c, d: {"x0": a, "y0": b, "x1": c, "y1": d}
    f = spark.createDataFrame([("keep", None, "c", 2, box(0.0, 0.0, 200.0, 200.0)), ("small", None, "c", 2, box(0.0, 0.0, 100.0, 200.0)), ("clip", "rendered_clip", "c", 2, None), ("scan", "vl_detected_scan", "", 2, None), ("cover", None, "", 1, None), ("nobox", None, "", 2, None)], f"figure_id string, derived_from string, caption_text_clean string, page_num_1 int, bbox {records.BBOX}")
    assert sorted(r[0] for r in f.filter(fg.is_substantial()).select("figure_id").collect()) == ["keep", "nobox"]
    figs = spark.createDataFrame([("d", 1, "f", box(0.0, 0.0, 100.0, 100.0))], f"doc_id string, page_num_1 int, figure_id string, bbox {records.BBOX}")
    lines = spark.createDataFrame([("d", 1, box(0.0, 110.0, 50.0, 120.0), "Plate 3"), ("d", 1, box(0.0, 130.0, 50.0, 140.0), "of tin"), ("d", 1, box(0.0, 400.0, 50.0, 410.0), "far")], f"doc_id string, page_num_1 int, bbox {records.BBOX}, text string")
    cap = fg.captions(figs, lines)
    assert cap.first()["caption"] == "Plate 3 of tin"
    assert fg.plates(cap).first()["plate_label"] == "Plate 3"
    spans = spark.createDataFrame([([{"x0": 0.0, "y0": 0.0, "y1": 10.0, "text": "a"}, {"x0": 5.0, "y0": 1.0, "y1": 11.0, "text": "b"}, {"x0": 0.0, "y0": 20.0, "y1": 30.0, "text": "c"}],)], "s array<struct<x0:double,y0:double,y1:double,text:string>>")
    assert spans.select(fg.group_lines(F.col("s"))).first()[0] == ["a b", "c"]


def test_metadata(spark):
    docs = spark.createDataFrame([("d", "X (1999) y.pdf", None, None, [])], "doc_id string, source_filename string, title string, document_type string, keywords array<string>")
    answers = spark.createDataFrame([("d", '```json\n{"title": "T", "document_type": "index", "keywords": [" a ", "b"]}\n```')], "doc_id string, answer string")
    r = md.merge_model_answer(docs, answers).first()
    assert (r["title"], r["document_type"], r["keywords"]) == ("T", "index", ["a", "b"])
    cat = {"web": spark.createDataFrame([("d", "W")], "doc_id string, title string"), "crossref": spark.createDataFrame([("d", "C")], "doc_id string, title string")}
    assert md.merge_catalogues(docs, cat).first()["title"] == "C"


def test_records_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("d", "a.pdf")], "doc_id string, source_filename string")
    blocks = spark.createDataFrame([("b", "d", 1, "x")], "block_id string, doc_id string, page_num_1 int, text_raw string").withColumn("reading_order", F.lit(0))
    root = f"file://{tmp_path}/out"
    records.write_bundle({"documents": docs, "text_blocks": blocks}, root)
    got = records.read_bundle(spark, root)
    assert got["documents"].first()["keywords"] == [] and got["documents"].first()["page_offset"] == 0
    assert got["text_blocks"].first()["block_type"] == "paragraph" and got["figures"].count() == 0
    assert records.pages_selected("1-3,7") == [1, 2, 3, 7]


def test_providers(spark):
    pages = spark.createDataFrame([("d", 1, bytearray(b"# T")), ("d", 2, bytearray(b"\xff"))], "doc_id string, page_num_1 int, content binary")
    got = {r["page_num_1"]: (r["markdown"], r["error"] is None) for r in PlainReader().pages(pages).collect()}
    assert got == {1: ("# T", True), 2: (None, False)}
    from folioloom.functions import lang

    cases = {"the cat and the dog of the house is here with us": "en", "short": "unknown", "orang itu tidak ada dalam rumah ini dan juga": "ms", "这是一个很长的中文句子用来测试语言识别的功能是否正常工作可以吗": "zh", "هذا نص طويل باللغة العربية لاختبار التعرف على اللغة": "ar", "zzz " * 20: "unknown", None: "unknown"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    found = {r["t"]: r["l"] for r in df.select("t", lang.detect(F.col("t")).alias("l")).collect()}
    assert {t: x["lang"] for t, x in found.items()} == cases
    assert found["short"]["confidence"] == 0.0 and all(len(x["candidates"]) <= 3 for x in found.values())
    assert set(lang.LANGUAGES) == {"en", "ms", "zh", "ar", "fr", "de", "nl", "pt", "es", "it", "la"}


def test_stream_of_files(spark, tmp_path):
    folder = tmp_path / "processed" / "doc-1" / "v2" / "text_blocks"
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_text('{"block_id": "b", "doc_id": "doc-1", "page_num_1": 1, "text_raw": "x"}\n\n')
    seen = []
    q = ingest.ingest(ingest.arrivals(spark, f"file://{tmp_path}"), f"file://{tmp_path}/cp", lambda batch, _: seen.extend(batch.select("doc_id", "version").collect()))
    q.awaitTermination()
    assert [tuple(r) for r in seen] == [("doc-1", 2)]
    keys = spark.createDataFrame([("processed/d/v12/documents.jsonl",), ("uploads/x.pdf",)], "k string")
    assert [tuple(r) for r in keys.select(*ingest.trigger_parts(F.col("k"))).collect()] == [("d", 12), ("", None)]


def test_agent_calls_tools_and_numbers_on(spark):
    from folioloom.plans import agent
    from folioloom.sources.providers import ChatProvider

    chunks, docs = corpus(spark)
    figs = spark.createDataFrame([("f1", "d1", 3, "tin map", [1.0, 0.0])], "figure_id string, doc_id string, page_num int, caption string, embedding array<float>")

    class Two(HashEmbedder):
        def embed(self, texts):
            return [[1.0, 0.0] for _ in texts]

    class Chat(ChatProvider):
        seen: list = []

        def complete(self, messages, max_tokens=512, temperature=0.0, tools=None):
            Chat.seen.append(messages[-1])
            if messages[-1]["role"] == "user":
                ask = lambda i, n, a: {"id": i, "function": {"name": n, "arguments": a}}
                return {"content": "", "tool_calls": [ask("1", "keyword_search", '```json\n{"keyword": "rubber"}\n```'), ask("2", "document_context", {"doc_id": "d2", "page_num": 5}), ask("3", "find_images", {"query": "tin"}), ask("4", "browse_corpus", {"publication": "JMBRAS"})]}
            return {"content": "done [1]"}

    c = agent.Corpus(chunks, docs, figs, Two())
    got = agent.answer(c, Chat(), "tin", [{"role": "assistant", "content": "old [3] Sources: x"}])
    assert got.text == "done [1]" and got.rounds == 1 and got.sources[0]["chunk_id"] == "c1"
    assert Chat.seen[-1]["content"].startswith("1. Tin mining by Azmi Khalid, A. (1950) [Index]")
    n = len(agent.search_documents(c, {"query": "tin"}, 1)[1])
    text, rows = agent.call(c, "document_context", {"doc_id": "d2", "page_num": 5}, n + 1)
    assert text.startswith(f"[{n + 1}] (Page 5)") and [r["chunk_id"] for r in rows] == ["c4"]
    assert "tin map" in agent.call(c, "find_images", {"query": "tin"})[0]
    assert {d["function"]["name"] for d in agent.definitions()} == set(agent.TOOLS)
    small = agent.answer(c, Chat(), "tin", window=600)
    assert small.rounds == 0 and len(small.sources) == 1


def test_streaming_status_keeps_the_furthest_stage(spark, tmp_path):
    rows = [("a", "done", "2024-01-02 00:00:00"), ("a", "processing", "2024-01-03 00:00:00"), ("b", "uploaded", "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "filename string, stage string, at string").selectExpr("filename", "stage", "timestamp(at) AS updated_at").write.parquet(f"{tmp_path}/in")
    kind = "filename string, stage string, updated_at timestamp"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ingest.state_store(spark)
    known = spark.createDataFrame([("a", "indexing", "2024-01-01"), ("c", "done", "2024-01-01")], "filename string, stage string, at string").selectExpr("filename", "stage", "timestamp(at) AS updated_at")

    def run():
        s = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        seen = []
        q = ingest.ordered_status(s, stored=known).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda b, _: seen.extend(b.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
        return {(r["filename"], r["stage"], r["stuck"]) for r in seen}

    # b's last event is more than six hours older than the watermark
    assert run() == {("a", "done", False), ("b", "uploaded", False), ("b", "uploaded", True)}
    # after a restart the state is there: c was done before the stream began, so that it doesn't go back, and b moves on
    more = [("c", "processing", "2024-01-04 00:00:00"), ("b", "processed", "2024-01-04 01:00:00"), ("d", "error", "2024-01-09 00:00:00")]
    spark.createDataFrame(more, "filename string, stage string, at string").selectExpr("filename", "stage", "timestamp(at) AS updated_at").write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == {("b", "processed", False), ("b", "processed", True), ("d", "error", False)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    e = spark.readStream.schema("filename string, stage string, updated_at timestamp").parquet(f"{tmp_path}/in").selectExpr("filename AS key", "updated_at AS ts")
    once = []
    q = ingest.without_repeats(e, late="9 days").writeStream.option("checkpointLocation", f"{tmp_path}/cp2").foreachBatch(lambda b, _: once.extend(b.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["key"] for r in once) == ["a", "b", "c", "d"]


def test_answers_are_whole_and_sources_from_all_documents(spark, tmp_path):
    from folioloom.plans import search

    d = str(tmp_path)
    spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(5).alias("n_chars")).write.parquet(f"{d}/documents.parquet")
    text = "x" * 60 + " as in [9, 11]."
    spark.range(100).select(F.col("id").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(text).alias("text")).write.parquet(f"{d}/conversations.parquet")
    assert all({9, 11} <= set(map(int, r["cited"].split(","))) for r in search.citation_extract(spark, d).collect())
    assert {9, 11} <= {r["old"] for r in search.citation_renumber_map(spark, d).collect()}
    assert all(len(r["text"]) > 60 and r["text"].endswith("].") and "9, 11" not in r["text"] for r in search.renumbered_answers(spark, d).collect())
    sources = search._sources(spark, d).select("answer_id", "position", "doc_id").collect()
    assert len(sources) == 700 and max(r["doc_id"] for r in sources) > 900 and len({r["doc_id"] for r in sources}) > 300
    of = {(r["answer_id"], r["position"]): r["doc_id"] for r in sources}
    assert all(len({of[a, p] for p in range(1, 8)}) == 6 and of[a, 1] == of[a, 6] for a, _ in of)

"""Operators on inline rows, and folds against models in plain Python."""

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from foliant.config import load_config
from foliant.functions import detect as D
from foliant.functions import text as T
from foliant import __main__ as cli
from foliant.operators import chunking, index, pages, report, retrieval, structure
from foliant.plans.catalogue import QUERIES
from foliant.plans.pipeline import ingest
from foliant.sources import readers, writers


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t"))).first()[0]


def split_model(text, size):
    out, cur, n = [], [], 0
    for w in text.split():
        if n + len(w) + 1 > size and cur:
            out.append(" ".join(cur))
            cur, n = [], 0
        cur.append(w)
        n += len(w) + 1
    return out + ([" ".join(cur)] if cur else [])


def pack_model(text, size, most):
    paras = [p.strip() for p in re.split(r"\n{2,}|\[PAGE_BREAK\]", text) if p.strip()]
    out, cur, n = [], [], 0
    for p in paras:
        if len(p) > most:
            if cur:
                out.append("\n\n".join(cur))
            cur, n = [], 0
            out += split_model(p, size)
            continue
        if n + len(p) > size and cur:
            out.append("\n\n".join(cur))
            cur, n = [], 0
        cur.append(p)
        n += len(p)
    return (out + (["\n\n".join(cur)] if cur else [])) or [text]


def test_pieces_equal_the_models(spark):
    rng = random.Random(1)
    texts = ["", " ", "one", "[PAGE_BREAK]"]
    for _ in range(80):
        texts.append("".join(rng.choice(["word ", "longerword ", "\n\n", "\n", "x" * 40 + " ", "[PAGE_BREAK]", "é "]) for _ in range(rng.randrange(60))))
    for t in texts:
        assert chunking.pack_paragraphs(t, 60, 90) == pack_model(t, 60, 90), t
        assert chunking.split_words(t, 30) == split_model(t, 30)
    df = spark.createDataFrame([*enumerate(texts), (99, None), (1, " ")], "document_id int, text string")
    got = {(r.document_id, r.pos, r.text) for r in chunking.paragraph_pieces(df, 60, 90).collect()}
    assert got == {(i, k, p) for i, t in enumerate(texts) for k, p in enumerate(pack_model(t, 60, 90))}
    assert chunking.chunk(df.where("false")).count() == 0


def test_chunk_queries_hold_documents_with_long_lines(spark, tmp_path):
    rng = random.Random(4)
    line = lambda n: " ".join("w" * rng.randrange(1, 12) for _ in range(n))
    texts = ["\n".join([line(40), line(900), line(60)]), line(2000), "\n".join(line(50) for _ in range(12)), "z" * 3500, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: pack_model(t.replace("\n", "\n\n"), 1000, 3000) for i, t in enumerate(texts)}
    got = {(r.document_id, r.pos, r.text) for r in QUERIES["paragraph_chunks"](spark, str(tmp_path)).collect()}
    assert got == {(i, k, c) for i, cs in want.items() for k, c in enumerate(cs)}

    def tail(b):
        cut = b[-150:]
        return b if len(b) <= 150 else cut[cut.find(" ") + 1 :] if cut.find(" ") > 0 else cut

    lapped = {i: [(tail(cs[k - 1]) + "\n" if k else "") + c for k, c in enumerate(cs)] for i, cs in want.items()}
    got = {(r.document_id, r.chunk_index, r.text) for r in QUERIES["overlap_chunks"](spark, str(tmp_path)).collect()}
    assert got == {(i, k, c) for i, cs in lapped.items() for k, c in enumerate([c.strip() for c in cs if len(c.strip()) >= 100])}


def test_every_document_has_its_composed_form(spark, tmp_path):
    texts = ["plain", "ﬁne ①", None, "", "e\u0301"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in QUERIES["nfkc_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: t and unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}


def test_lines_equal_python(spark):
    for t in ["", "a", "a\n", "a\r\nb", "a\n\nb\n", "\n", "a b", "a\x0cb\x1e", "a\r"]:
        assert one(spark, t, T.lines) == t.splitlines()


@settings(max_examples=8, deadline=None)
@given(st.text(alphabet=" \t\n 　ab", max_size=12))
def test_strip_equals_python(spark, t):
    assert one(spark, t, T.strip) == t.strip()
    assert one(spark, t, T.collapse) == " ".join(t.split())


@pytest.mark.parametrize("line, yes", [("1. Introduction", True), ("1.2.3. Deep", True), ("IV. Results", True), ("BACKGROUND AND SCOPE", True), ("results show much", True), ("a plain line", False), ("AB", False), ("x" * 151, False)])
def test_headings(line, yes):
    assert chunking.is_heading(line) is yes


def test_tail_words():
    assert chunking.tail_words("abc def ghi", 5) == "ghi"
    assert chunking.tail_words("abc", 5) == "abc"
    assert chunking.tail_words("abcdefghij", 5) == "fghij"


def test_page_cleaning(spark):
    assert one(spark, "exam-\nple \x00ﬁne\x0cx\n\n\n\n  y", T.clean_page) == "example fine x\n\ny"


def test_bibliographic_facts(spark):
    t = "J. of X, Vol. 12, pp. 3 – 9 (2011), doi 10.1234/ab.c5. Abstract\nThis is the abstract of the paper, it is long enough.\n\nKeywords: heat; flow.\n1 Introduction 1999"
    got = {k: one(spark, t, f) for k, f in dict(doi=D.doi, year=D.year, volume=D.volume, pages=D.page_range, keywords=D.keywords).items()}
    assert got == {"doi": "10.1234/ab.c5", "year": "2011", "volume": "12", "pages": "3-9", "keywords": "heat; flow"}
    assert one(spark, "Title\n\nAbstract\nThis is the abstract of the paper, it is long enough.\n\nIntroduction\nBody", D.abstract) == "This is the abstract of the paper, it is long enough."
    assert one(spark, "Abstract: too short", D.abstract) is None


def test_authors(spark):
    t = "Heat transfer in loops\nAnn Author1, Bob Writer2\nUniversity of Nowhere\nReceived 3 May\nAbstract\nText"
    rows = [(t, "Heat transfer in loops"), (t, None), (None, None), ("", "x"), ("One\nAnn Author\nALL CAPITALS\nKeywords: none", "Unfound zebras there")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(D.front_authors(F.col("a"), F.col("b"))).collect()]
    assert got == ["Ann Author, Bob Writer", "Ann Author, Bob Writer", None, None, "Ann Author"]


def test_equation_signs(spark):
    assert one(spark, "∂u/∂t = α∇²u", D.math_density) and not one(spark, "plain words here", D.math_density)
    assert one(spark, "q = m c (3a)", D.equation_label) == "(3a)" and one(spark, "see Eq. (2) there (3)", D.equation_label) == "Eq. (2)"
    assert one(spark, "q = m c (3A)", D.equation_label) is None
    assert one(spark, "see Fig. 1, Figure 1 and fig. 1", lambda c: D.mentions(c, D.FIG_MENTION)) == ["fig. 1", "figure 1"]


def a_pages(spark, docs):
    return spark.createDataFrame(list(docs.items()), "document_id string, pages array<string>")


BODY = "The body of this page says something of its own number %s, and goes on for a while so that it counts as text.\n" * 2


def test_validation_statuses(spark):
    docs = {"ok": [BODY % (i, i) for i in "abcd"], "empty": ["", ""], "garbage": ["\x01" * 90 + "x" * 60] * 2, "half": [BODY % (1, 1), "", "", ""], "head": ["Header 1\n" + BODY % (c, c) for c in "abcde"]}
    got = {r.document_id: r for r in pages.validate(a_pages(spark, docs)).collect()}
    assert got["ok"].quality_status == "ok" and got["ok"].quality_score == 1.0
    assert got["empty"].quality_status == "failed" and got["empty"].quality_score == 0
    assert got["garbage"].garbage_char_ratio > 0.5 and got["garbage"].quality_status == "ok_with_warnings"
    assert got["half"].quality_score == pytest.approx(0.6) and got["head"].duplicate_line_ratio == 1.0


def test_repeated_lines_go(spark):
    docs = {"d": [f"Running head {i}\nbody {c * 3}\nsame" if i < 5 else f"body {c}" for i, c in enumerate("abcde", 1)], "short": ["x\nsame"] * 3}
    got = {(r.document_id, r.page_num): r.text for r in pages.page_rows(pages.strip_boilerplate(a_pages(spark, docs))).collect()}
    assert got["d", 1] == "body aaa" and got["d", 5] == "body e" and got["short", 1] == "x\nsame"
    text = {r.document_id: r.text for r in pages.normalise(a_pages(spark, docs)).collect()}
    assert text["d"].split("\n\n[PAGE_BREAK]\n\n") == ["body aaa", "body bbb", "body ccc", "body ddd", "body e"]


def test_chunks_and_their_pages(spark):
    docs = a_pages(spark, {"d": [f"Page {i} begins.\n\n" + "\n\n".join(f"Paragraph {i}-{k} has its own words, so many that packing starts." for k in range(12)) for i in range(1, 6)]})
    whole = pages.normalise(docs, strip_repeated=False)
    chunks = chunking.chunk(whole, 300, 50, 20, 1000).orderBy("chunk_index").collect()
    assert [c.chunk_index for c in chunks] == list(range(len(chunks))) and len(chunks) > 8
    starts = [c.page_start for c in chunks]
    assert starts == sorted(starts) and starts[0] == 1 and chunks[-1].page_end == 5
    assert all(b.text.startswith(T_tail) for a, b, T_tail in [(a, b, b.text.split("\n")[0]) for a, b in zip(chunks, chunks[1:])])


def test_choice_and_ocr(spark):
    a = spark.createDataFrame([("a", 0.4, "first"), ("b", 0.6, "first"), ("c", 0.4, "first")], "document_id string, score double, method string")
    b = spark.createDataFrame([("a", 0.6, "second"), ("b", 1.0, "second"), ("c", 0.5, "second")], "document_id string, score double, method string")
    assert {r.document_id: r.method for r in pages.choose_extraction(a, b).collect()} == {"a": "second", "b": "first", "c": "first"}
    weak = spark.createDataFrame([("d", ["", "x" * 80, " " * 30], ["recognised words", "y" * 90, "short"]), ("e", [""], None)], "document_id string, pages array<string>, ocr array<string>")
    got = {r.document_id: r for r in pages.upgrade_with_ocr(weak).collect()}
    assert got["d"].pages == ["recognised words", "x" * 80, " " * 30] and got["d"].ocr_pages == [1] and not got["e"].ocr_used


def test_decoding_falls_back_and_recognises():
    text = "a page of text that is long enough to count as one, for sure"
    d = readers.Decoders(lambda b: ["", "", text], lambda b: [text, text, ""], lambda b, k: f"page {k} as it was read by the recogniser")
    got = readers.extract_one(b"x", d)
    assert got["method"] == "hybrid" and got["fallback_used"] and got["pages"][:2] == [text, text] and got["ocr_pages"] == [3] and got["success"]

    def no(*_):
        raise readers.NoRecogniser("none is installed")

    got = readers.extract_one(b"x", readers.Decoders(lambda b: ["", ""], None, no))
    assert got["warnings"] == ["none is installed"] and not got["success"] and got["method"] == "first"

    def locked(_):
        raise readers.Encrypted("secret")

    assert readers.extract_one(b"x", readers.Decoders(locked))["is_encrypted"] and readers.extract_one(b"", d)["errors"] == ["empty file"]
    assert readers.extract_one(b"x", readers.Decoders(lambda b: []))["warnings"] == ["no pages"]
    broken = readers.extract_one(b"x", readers.Decoders(no))
    assert broken["is_corrupted"] and broken["errors"] == ["none is installed"]


def test_index_changes(spark):
    s = "chunk_id string, document_id string, text string, n int"
    old = spark.createDataFrame([("1", "a", "t", 1), ("2", "b", "t", 1)], s)
    new = spark.createDataFrame([("3", "a", "u", 2), ("2", "b", " ", 2)], s)
    assert {r.chunk_id for r in index.replace_documents(old, new.where("document_id = 'a'")).collect()} == {"2", "3"}
    assert {(r.chunk_id, r.n) for r in index.upsert(old, new, "chunk_id").collect()} == {("1", 1), ("2", 1), ("3", 2)}
    assert index.latest(old.unionByName(new), ["chunk_id"], "n").where("chunk_id = '2'").first().n == 2
    assert [index.clamp(k) for k in (-1, 5, 99)] == [1, 5, 20]


def test_retrieval(spark):
    texts = ["heat pump and compressor", "court ruling and appeal", "heat pump", None]
    df = retrieval.embed(spark.createDataFrame([(str(i), "d", t, 1) for i, t in enumerate(texts)], "chunk_id string, document_id string, text string, page_start int"))
    r = retrieval.Retriever(df)
    assert [x.chunk_id for x in r.search("heat pump", 2).collect()] == ["2", "0"]
    assert r.answer("heat pump", 1)["warning"] == "no generator is configured"
    got = retrieval.Retriever(df.withColumn("page_end", F.lit(1)), generator=lambda q, c: c).answer("heat pump", 1)
    assert got["answer"].startswith("[Fragmento 1]\nDocumento: d\nPágina: 1\nTexto:\nheat pump")
    assert r.status()["chunks"] == 4
    assert [x.chunk_id for x in r.search("heat pump", 2, "chunk_id <> '2'").collect()] == ["0", "1"]
    with pytest.raises(retrieval.EmptyIndex):
        retrieval.Retriever(df.where("false")).search("heat pump")
    assert retrieval.Retriever(df.where("false")).answer("heat pump")["warning"] == "the index is empty"
    assert retrieval.embed(df, embedder=lambda t: 1 / 0).where("embedding is null").count() == 4


def test_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(40)] + [(40, None), (41, [0.0] * 5), (42, [1.0])]
    v = spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(5)
    got = {}
    for r in retrieval.vector_neighbours(v, v.where("id < 10"), 4, "id").orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.neighbour)

    def distance(a, b):
        return round(1 - sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 4)

    assert got == {q: sorted(range(40), key=lambda j: (distance(rows[q][1], rows[j][1]), j))[:4] for q in range(10)}
    assert retrieval.vector_neighbours(v, v.where("false"), 4, "id").count() == 0


def test_reports(spark, tmp_path):
    s = "document_id string, status string, n int"
    old = spark.createDataFrame([("a", "completed", 1), ("b", "completed", 1)], s)
    new = spark.createDataFrame([("a", "skipped", 2), ("b", "failed", 2)], s)
    assert {(r.document_id, r.status) for r in report.save_report(old, new, "n").collect()} == {("a", "completed"), ("b", "failed")}
    assert report.as_json(spark.createDataFrame([("a", None)], "x string, y string")).first()[0] == '{"x":"a","y":null}'


def test_files_to_chunks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("\f".join("A page of text. " * 20 for _ in range(3)))
    (folder / "b.txt").write_text(" ")  # the reader passes over files of no bytes
    files = readers.scan_folder(spark, str(folder), "*.txt")
    assert files.count() == 2 and len(files.first().document_id) == 32
    frames = ingest(files)
    got = {r.source_file: r for r in frames["reports"].collect()}
    assert got["a.txt"].chunks_created > 0 and got["a.txt"].ready_for_rag and got["b.txt"].quality_status == "failed" and not got["b.txt"].ready_for_rag
    assert {r.chunk_type for r in frames["chunks"].collect()} == {"text"} and frames["chunks"].where("embedding is null").count() == 0
    out = str(tmp_path / "chunks")
    writers.save_table(frames["chunks"], out)
    assert spark.read.parquet(out).count() == frames["chunks"].count()
    js = str(tmp_path / "js")
    assert writers.append_index(frames["chunks"].select("chunk_id", "document_id", "text"), js) and not writers.append_index(frames["chunks"].where("false"), js)
    (tmp_path / "js" / "bad.json").write_text("{not json\n\n")
    assert readers.read_jsonl(spark, js).count() == frames["chunks"].count()


def test_the_command_line_replaces(spark, tmp_path, capsys):
    folder, base = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    page = "The heat pump of Table 1 and Eq. (2) was measured again. " * 8 + "\nNu = 0.023 Re^0.8 Pr^0.4 (2)\n" + "More text of this page follows here. " * 8
    (folder / "a.txt").write_text("\f".join([page] * 3))
    (folder / "b.txt").write_text("Another document on court rulings. " * 40)

    def counts():
        return {n: spark.read.parquet(f"{base}/{n}").count() for n in ("chunks", "reports", "equations", "metadata", "academic")}

    assert cli.main(["--data", base, "process-folder", str(folder), "--pattern", "*.txt"]) == 0
    first = counts()
    assert first["reports"] == 2 and first["equations"] == 6 and spark.read.parquet(f"{base}/chunks").where("chunk_type = 'equation'").count() == 6  # the number, and the mention in the text
    assert spark.read.parquet(f"{base}/equations").where("size(mentioned_in_chunks) > 0").count() == 3
    (folder / "b.txt").write_text("Another document on court rulings, made longer. " * 40)
    assert cli.main(["--data", base, "process-folder", str(folder), "--pattern", "*.txt"]) == 0
    assert {k: n for k, n in counts().items() if k != "chunks"} == {k: n for k, n in first.items() if k != "chunks"}
    assert counts()["reports"] == 2 and spark.read.parquet(f"{base}/chunks").where("text like '%made longer%'").count() > 0
    assert spark.read.parquet(f"{base}/chunks").where("text like '%court rulings. Another%'").count() == 0
    name = spark.read.parquet(f"{base}/reports").where("source_file = 'a.txt'").first().document_id
    capsys.readouterr()
    for argv, said in ((["list-docs"], "a.txt"), (["status"], "'available': True"), (["search", "heat pump"], "a.txt"), (["show-report", name], "status: completed"), (["ask", "heat pump"], "no generator"), (["index-stats"], "'total_documents': 2"),
                       (["tool", "search_papers", "heat pump"], "[1]"), (["tool", "get_paper_info", name], "citation_key"), (["tool", "list_papers"], "chunks)"), (["tool", "get_paper_chunks", name], "chunks"), (["tool", "knowledge_base_stats"], "documents: 2"), (["tool", "rag_search", "heat pump"], "[Fragmento 1]"), (["tool", "rag_answer", "heat pump"], "[1]"), (["tool", "rag_sources", "heat pump"], "[1]"), (["tool", "rag_status"], "available")):
        assert cli.main(["--data", base, *argv]) == 0
        assert said in capsys.readouterr().out, argv
    assert cli.main(["--data", base, "show-report", "x' OR '1'='1"]) == 1


def test_boxes_meet_their_grids(spark):
    g = spark.createDataFrame([("d", 1, ["x", "y"]), ("e", 1, ["z"])], "document_id string, page_num int, grids array<string>")
    b = spark.createDataFrame([("d", 1, [1.0])], "document_id string, page_num int, boxes array<double>")
    assert {(r.document_id, r.table_no, r.cells, r.bbox) for r in structure.paired_boxes(g, b).collect()} == {("d", 1, "x", 1.0), ("d", 2, "y", None), ("e", 1, "z", None)}


def test_new_files_once(spark, tmp_path):
    from foliant.plans.pipeline import to_chunks
    from foliant.streaming.ingest import ingest_stream

    folder = tmp_path / "in"
    folder.mkdir()
    target, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        ingest_stream(spark, str(folder), "*.txt", target, state, to_chunks).awaitTermination()
        return {r.source_file for r in spark.read.parquet(target).collect()}

    (folder / "a.txt").write_text("Some page of text. " * 20)
    assert run() == {"a.txt"}
    n = spark.read.parquet(target).count()
    (folder / "b.txt").write_text("Another page of text. " * 20)
    assert run() == {"a.txt", "b.txt"}
    assert spark.read.parquet(target).where("source_file = 'a.txt'").count() == n


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("chunk_size: 500\nunknown: 1\nembeddings_enabled: 'no'\n")
    c = load_config(p, {"FOLIANT_CHUNK_OVERLAP": "20", "FOLIANT_DATA_DIR": "/x"})
    assert (c.chunk_size, c.chunk_overlap, c.embeddings_enabled, str(c.data_dir)) == (500, 20, False, "/x")
    assert load_config(tmp_path / "none").chunk_size == 1000

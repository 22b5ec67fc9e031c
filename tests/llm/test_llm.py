"""Each operator against brute force on small fixtures, and on the rows that break things: null, empty and very long texts, ties, repeated rows, empty tables, other columns of clashing names."""

import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import _bloom, langid, leakage, names, neardup, pack, quality, scans, split, subjects, unify

PROSE = "The compressor was measured in the second series and it was stable. We compared each result with the reference of the former year. "
LONG = PROSE * 400
ODD = [(1, None, "x"), (2, "", "x"), (3, "a", "x"), (4, PROSE, "x"), (4, PROSE, "x"), (5, LONG, None), (None, PROSE, "y")]


@pytest.fixture(scope="module")
def odd(spark):
    """Columns that clash with what the operators add."""
    rows = [(a, b, c, 7, "k", 1, "s") for a, b, c in ODD]
    return spark.createDataFrame(rows, "id bigint, t string, lang string, n_words int, kind string, piece int, sig string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- 1 scans


def a_reader(extra=()):
    words = {w: 50 for w in (*"the was measured again in and field cannot replace compressor value observation refrigerant procedure limitation reference known well wet bulb".split(), "wet-bulb", *extra)}
    return scans.Reader(words, {})


@pytest.mark.parametrize("read, printed", [("c0mpressor", "compressor"), ("lirnitation", "limitation"), ("refrigeront", "refrigerant"), ("proceclure", "procedure"), ("wa5", "was"), ("compressor", None), ("zzz", None)])
def test_misread_words(read, printed):
    assert a_reader().printed(read, (), False) == printed


@pytest.mark.parametrize("edits", [1, 2])
def test_levenshtein_automaton_finds_all_of_brute_force(edits):
    rng = random.Random(edits)
    make = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    vocabulary = sorted({make(rng.randrange(1, 9)) for _ in range(300)} | {"house"})
    asked = [make(rng.randrange(1, 9)) for _ in range(60)] + ["hpuse", "housee", "huse", "house", "", "x" * 100]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for w, got in zip(asked, scans.Automaton(vocabulary, edits).within(asked)):
        assert sorted(got) == sorted((v, distance(v, w)) for v in vocabulary if w and distance(v, w) <= edits)
    assert scans.Automaton([], edits).within(["a"]) == [[]]


def test_other_edits_need_the_text():
    from collections import Counter

    reader = a_reader(("house",))
    assert reader.printed("hpuse", Counter({"house": 1, "hpuse": 1}), False) is None
    assert reader.printed("hpuse", Counter({"house": 3, "hpuse": 1}), False) == "house"


def test_names_with_many_digits():
    reader = a_reader()
    assert reader.digits_out("a1b5c0d1e5f0g1", {"albscodiesfogi": 1, "x": 2}) is not None
    assert len(reader.digits_out("x1y5z0" * 20, set())) == 120 and not any(map(str.isdigit, reader.digits_out("x1y5z0" * 20, set())))


def test_automaton_finds_all_of_brute_force():
    words = {w: 1 for w in "and arid clan dan corn com barn bam ill lll hit tit lit bit".split()}
    trie = scans.Trie(words)

    def readings(w, most):
        out = {w}
        for _ in range(most):
            out |= {x[:i] + r + x[i + len(p) :] for x in out for p, r in scans.MISREAD for i in range(len(x)) if x.startswith(p, i)}
        return out

    for read in {r for w in words for r in readings(w, 1)}:
        got = set(scans.candidates(trie, read, 1))
        want = {w for w in words if read in readings(w, 1) - {w}}
        assert want <= got | {read}, (read, want, got)


def test_pages_are_repaired():
    pages = [
        "Title of the paper\n\nThe compres-\nsor was measured again. The ob-\n- 7 -",
        "Journal of Things, vol. 3\nservation was measured. The wet-\nbulb value was\n\n3.1\n4.2\n- 8 -",
        "Journal of Thlngs, vol. 3\nmeasured again.\n- 9 -",
    ]
    found, text = scans.find_in_pages(a_reader(), pages, True)
    assert set(found) == {(1, "page_number", "- 7 -"), (2, "page_number", "- 8 -"), (3, "page_number", "- 9 -"), (2, "running_line", "Journal of Things, vol. 3"), (3, "running_line", "Journal of Thlngs, vol. 3"), (1, "broken_word", "compressor"), (1, "broken_word", "observation"), (2, "broken_word", "wet-bulb")}
    assert "compressor was measured" in text and "observation was" in text and "wet-bulb value" in text and "Journal" not in text


def test_number_lines():
    assert scans.number_of("Page 12") == (12, True) and scans.number_of("xiv") == (14, False) and scans.number_of("[ 3 ]") == (3, True)
    assert scans.number_of("12.5") is None and scans.number_of("(1999).") is None and scans.number_of("civil") is None


def test_scan_frames(spark):
    schema = "document_id string, pages array<string>, noise string, page_num int"
    df = spark.createDataFrame([("a", None, "q", 1), ("b", [], "q", 1), ("c", [None, ""], "q", 1), ("d", ["The wa5\nend"] * 2, "q", 1), ("d", ["The wa5\nend"] * 2, "q", 1)], schema)
    got = scans.find_pages(df, ["document_id"], "pages", a_reader(("end",)))
    assert {(r["document_id"], r["page_num"], r["noise"], r["token"]) for r in rows(got)} >= {("d", 1, "misread", "was"), ("d", 2, "misread", "was")}
    assert scans.find_pages(df.where("false"), ["document_id"], "pages", a_reader()).count() == 0
    assert scans.page_furniture(df, "document_id", "pages").count() == 4
    reader = scans.reader_of(df.selectExpr("cast(null as string) t"), "t")
    assert reader.words == {}


def test_rare_words_are_found_in_a_large_corpus(spark):
    many = "the " * 1_400_000 + "limitation " * 300  # words of less than 8 of the total are outside the vocabulary
    rare = "saw Stairfaisnu and Vlersor here. " * 5 + "saw Stalrfaisnu and Vlcrsor and V1ersor, lirnitation lirnitation lirnitation lirnitation lirnitotion here."
    reader = scans.reader_of(spark.createDataFrame([(many,), (rare,)], "t string"), "t")
    assert "stairfaisnu" not in reader.words
    assert [reader.printed(w, (), False) for w in ("Stalrfaisnu", "Vlcrsor", "V1ersor", "Stairfaisnu")] == ["stairfaisnu", "vlersor", "vlersor", None]
    assert reader.printed("lirnitotion", (), False) == "limitation"  # and not lirnitation, which is misread itself
    assert all(w in ("stalrfaisnu", "vlcrsor", "v1ersor") for w in reader.rare)


def test_misreadings_keep_the_key(spark):
    df = spark.createDataFrame([(f"x{p}x", f"x{r}x") for p, r in scans.MISREAD], "p string, r string")
    assert df.where(scans.misread_key(F.col("p")) != scans.misread_key(F.col("r"))).count() == 0


def test_chunk_furniture(spark):
    marks = spark.createDataFrame([("d", [scans.fold_line("Printed at Here")], [6], 3)], "doc string, keys array<string>, offsets array<bigint>, n_pages int")
    df = spark.createDataFrame([("k", "d", "The compres-\nPrinted at Here\n8\nsor was measured", 2, 3), ("n", None, None, None, None), ("e", "d", "", 1, 1)], "id string, doc string, text string, a int, b int")
    got = {(r["id"], r["noise"], r["token"]) for r in rows(scans.find_chunks(df, ["id"], "doc", "text", "a", "b", marks, a_reader()))}
    assert got == {("k", "running_line", "Printed at Here"), ("k", "page_number", "8"), ("k", "broken_word", "compressor")}


def test_tables_keep_their_lines(spark):
    marks = spark.createDataFrame([("d", [scans.fold_line("value | 3")], [6], 3)], "doc string, keys array<string>, offsets array<bigint>, n_pages int")
    text = "the value was  measured\nvalue | 3\n\nc0mpressor | 8\n8\nwell paper_kula_000150.pdf"
    df = spark.createDataFrame([(k, "d", text, 2, 3, k) for k in ("table", "equation")] + [(None, "d", "The compres-\nsor was measured", 2, 3, None)], "id string, doc string, text string, a int, b int, kind string")
    got = {(r["id"], r["noise"], r["token"]) for r in rows(scans.find_chunks(df, ["id"], "doc", "text", "a", "b", marks, a_reader(), True, F.col("kind").isin("table", "equation")))}
    fixed = text.replace("c0mpressor", "compressor")
    assert got == {(k, n, t) for k in ("table", "equation") for n, t in (("misread", "compressor"), ("text", fixed))} | {(None, "broken_word", "compressor"), (None, "text", "The compressor was measured")}


def test_every_chunk_is_repaired(spark, data):
    from foliant.llm.queries import p1_repaired
    from foliant.session import table

    got = {r["rec_id"] for r in rows(p1_repaired(spark, data).where("rec_kind = 'chunk'"))}
    assert got == {r["chunk_id"] for r in rows(table(spark, data, "chunks").where("text is not null"))}


# ---- 2 split


def check_pieces(text, pieces, limit, overlap):
    assert "".join(text[s + o : e] for s, e, o, _ in pieces) == text
    assert all(e - s <= limit for s, e, _, _ in pieces)
    assert all(0 <= o <= overlap for _, _, o, _ in pieces)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "Sentence ends. ", "line\n", "para\n\n", "x" * 90, "é́", "。", "‍"]), min_size=20, max_size=400), st.sampled_from([(100, 0), (100, 20), (300, 60)]))
def test_pieces_of_any_text(parts, sizes):
    text = "".join(parts)
    limit, overlap = sizes
    if len(text) > limit:
        check_pieces(text, split.split_texts([text], limit, overlap)[0], limit, overlap)


def test_runs_of_marks_lose_nothing():
    for text in ("a" + chr(0x301) * 5600, chr(0x301) * 9000, "x " * 300 + chr(0x200D) * 4000 + " y" * 300):
        check_pieces(text, split.split_texts([text], 500, 100)[0], 500, 100)


def test_doubling_equals_following_the_chain():
    for text in (LONG, "ab " * 5000, "x" * 20000, "One. " * 3000):
        pos, kind = split.boundaries(text, 700)
        jump, _ = split.successors(pos, kind, 3000, 150)
        at, want = 0, {0}
        while jump[at] != at:
            at = int(jump[at])
            want.add(at)
        assert set(np.flatnonzero(split.cuts_by_doubling(jump, np.array([0])))) == want


def test_split_frame(odd, empty):
    got = rows(split.split_oversized(odd, ["id"], "t"))
    assert {r["id"] for r in got if r["n_pieces"] > 1} == {5}
    assert sum(r["id"] == 4 for r in got) == 2 and sum(r["piece_text"] is None for r in got) == 1
    assert split.split_oversized(empty, ["id"], "t").count() == 0
    with pytest.raises(ValueError):
        split.split_oversized(odd, ["id"], "t", 100, 60)


# ---- 3 near duplicates


def brute(texts, width, threshold):
    words = {k: neardup.WORD.findall(t.lower()) for k, t in texts.items()}
    sets = {k: {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()) for k, w in words.items()}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(60)] for _ in range(60)]
    texts = {}
    for i, b in enumerate(base):
        texts[f"{i:03}a"] = " ".join(b)
        for k in range(rng.randrange(4)):
            c = b[:]
            for _ in range(rng.randrange(6)):
                c[rng.randrange(60)] = rng.choice(vocab)
            texts[f"{i:03}b{k}"] = " ".join(c).title()
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    found = neardup.near_pairs(*neardup.near_duplicates(df, "id", "text", 0.5, 3), "id")
    want = brute(texts, 3, 0.5)
    got = {(r["id_a"], r["id_b"]) for r in rows(found)}
    assert got <= want and len(got) >= 0.98 * len(want)


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 150), st.integers(0, 5), st.integers(0, 10_000))
def test_bit_sliced_distances(n, blocks, seed):
    rng = np.random.default_rng(seed)
    protos = rng.integers(0, 256, (max(1, n // 6), neardup.HASHES * neardup.BITS // 8), dtype=np.uint8)
    sig = protos[rng.integers(0, len(protos), n)] ^ (rng.integers(0, 256, (n, protos.shape[1]), dtype=np.uint8) & rng.integers(0, 256, (n, protos.shape[1]), dtype=np.uint8) & rng.integers(0, 256, (n, protos.shape[1]), dtype=np.uint8))
    block = np.sort(rng.integers(0, blocks + 1, n))
    side = np.zeros(n, dtype=np.int64)
    radius = neardup.radius_of(0.5)
    bits = np.unpackbits(sig, axis=1).astype(int)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if block[i] == block[j] and (bits[i] != bits[j]).sum() <= radius}
    assert set(neardup.close_pairs(block, side, sig, radius)) == want


def test_large_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    texts = {f"{i:02}": "same words in all of the texts here again and again for a long while " * 2 + f"tail{i}" for i in range(23)}
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    want = brute(texts, 3, 0.5)
    for sampled in (64, 1):  # with 1 every band is seen, and is salted as a very large one
        monkeypatch.setattr(neardup, "SAMPLED", sampled)
        assert {(r["id_a"], r["id_b"]) for r in rows(neardup.near_pairs(*neardup.near_duplicates(df, "id", "text", 0.5, 3), "id"))} == want
    assert neardup.large_bands(neardup.sketches(df, "id", "text", 3))


def test_groups_follow_chains_and_copies(spark, odd, empty):
    words = [f"v{i}" for i in range(120)]
    chain = {i: " ".join(words[i * 4 : i * 4 + 60]) for i in range(8)} | {20: "unlike anything else that stands here", 21: "", 22: chr(0x2022)}
    df = spark.createDataFrame([*chain.items(), (0, chain[0]), (30, chain[0])], "id bigint, text string")
    got = {r["id"]: r for r in rows(neardup.groups(*neardup.near_duplicates(df, "id", "text", 0.8, 3), "id"))}
    assert len({got[i]["group"] for i in range(8)}) == 1 and got[30]["group"] == got[0]["group"] and got[20]["n_links"] == 0 and 21 not in got
    m, links = neardup.near_duplicates(odd, "id", "t", 0.5, 3)
    assert {(r["id_a"], r["id_b"]) for r in rows(neardup.near_pairs(m, links, "id"))} == {(4, 5)}  # the long text repeats the short one
    m, links = neardup.near_duplicates(empty, "id", "t", 0.5, 3)
    assert neardup.near_pairs(m, links, "id").count() == 0


def test_only_paired_chunks_are_rated(spark, data, monkeypatch):
    from foliant.llm import queries

    pairs = {(r["id_a"], r["id_b"]) for r in rows(neardup.near_pairs(*queries.near_chunks(spark, data), "chunk_id"))}
    other = {r["chunk_id"] for r in rows(queries.p4_found(spark, data))}
    rate, rated = quality.quality_stats, []
    monkeypatch.setattr(quality, "quality_stats", lambda df, *a: rated.append(df) or rate(df, *a))
    got = {(r["id_a"], r["id_b"]) for r in rows(queries.p3_found(spark, data)) if r["rec_kind"] == "chunk"}
    assert got and got == {p for p in pairs if not other & set(p)}
    ids = {r["chunk_id"] for df in rated for r in rows(df.select("chunk_id"))}
    chunks = spark.read.parquet(f"{data}/chunks.parquet").where("chunk_type = 'text'").count()
    assert {i for p in pairs for i in p} <= ids and len(ids) < chunks / 2


def test_filter_loses_no_row(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id n", "concat('k', id) k").unionByName(spark.createDataFrame([(-1, None)], "n bigint, k string"))
    keys = df.where("n % 50 = 0 or n = -1").select("k")
    want = set(range(0, 5000, 50))
    for most in (1 << 27, 8):  # with 8 bits all rows pass
        monkeypatch.setattr(_bloom, "MOST_BITS", most)
        got = {r["n"] for r in rows(_bloom.among(df, "k", keys))}
        assert want <= got and -1 not in got and (len(got) < 150) == (most > 8)
    monkeypatch.setattr(_bloom, "MOST_BITS", 1 << 27)
    assert _bloom.among(df, "k", keys.where("false")).count() == 0


def test_works(spark):
    t = "Adjusted measurement of the wetland in the Sivodavebo series"
    data = [("a", "10.9999/x.1", t), ("b", "https://doi.org/10.9999/X.1", "other"), ("c", None, "ADJUSTED measurment of wetland in Sivodavebo series."), ("d", "10.9999/x.2", t), ("e", None, t.replace("Sivodavebo", "Nadedireba")), ("f", None, None), ("a", "10.9999/x.1", t)]
    df = spark.createDataFrame(data, "paper_id string, doi string, title string")
    got = {(r["id_a"], r["id_b"]) for r in rows(neardup.same_works(df, "paper_id", "doi", "title"))}
    assert got == {("a", "b"), ("a", "c"), ("c", "d")}
    assert neardup.same_works(df.where("false"), "paper_id", "doi", "title").count() == 0


# ---- 4 quality


@pytest.mark.parametrize(
    "text, kind",
    [
        (PROSE, "prose"),
        (PROSE.upper(), "prose"),
        (PROSE + "\n- one\n- two\n" + PROSE, "prose"),
        ("- one thing\n- two things\n- three", "list"),
        ("1.1 Chiller ........ 2\n1.2 Load ......... 5", "list"),
        ("| a | b |\n| --- | --- |\n| 1 | 2 |", "table"),
        ("a;1.5;7\nb;2.5;8\nc;3;9", "table"),
        ("1 2.5 3\n4 5 6", "table"),
        ("000000: 2c 56 37 eb 60 e2\n000010: 58 f9 aa 0e c5 6b", "junk"),
        ("nan " * 60, "junk"),
        ("$%&/ §§ =#", "junk"),
        ("\n".join(["Chapter on loads .... 7"] * 9 + ["The value was measured in the second series."] * 11), "prose"),
        ("\n".join(["Chapter on loads .... 7"] * 19 + ["The value was measured."]), "list"),
    ],
)
def test_kinds(spark, text, kind):
    assert rows(quality.quality_stats(spark.createDataFrame([(1, text)], "id int, t string"), ["id"], "t"))[0]["kind"] == kind


def test_statistics_equal_counting(odd, empty):
    got = rows(quality.quality_stats(odd, ["id"], "t"))
    assert len(got) == len(ODD)
    for r in got:
        t = next(b for a, b, _ in ODD if a == r["id"]) or ""
        seen = [c for c in t if not c.isspace()]
        assert r["n_chars"] == len(t) and r["n_words"] == len(t.split())
        assert r["mean_word_len"] == pytest.approx(len(seen) / max(1, len(t.split())))
        assert r["symbol_ratio"] == pytest.approx(sum(not c.isalnum() for c in seen) / max(1, len(seen)))
    assert [r["failures"] for r in got if r["id"] == 2] == [["empty"]] and [r["kind"] for r in got if r["id"] == 1] == [None]
    assert quality.quality_stats(empty, ["id"], "t").count() == 0


# ---- 5 unify


@pytest.mark.parametrize(
    "text, plain",
    [("ｌ＇ｅｓｓａｉ", "l'essai"), ("conﬁg", "config"), ("lа сараcité", "la capacité"), ("С'еѕt", "C'est"), ("a b　c d", "a b c d"), ("ex​periment", "experiment"), ("été", "été"), ("CO₂ ½ m² «x»", "CO₂ ½ m² «x»"), ("mɡrɑin x‐y", "mgrain x-y"), ("հօտ", "հօտ"), ("Жульня Щуга", "Жульня Щуга"), ("Φως Θίψα", "Φως Θίψα"), ("ΔT β² ε_b ν", "ΔT β² ε_b ν"), ("plain text", "plain text"), (None, None), ("", "")],
)
def test_forms(spark, text, plain):
    r = rows(unify.unify(spark.createDataFrame([(1, text, True)], "id int, t string, changed boolean"), ["id"], "t"))
    assert [(x["text_norm"], x["changed"]) for x in r] == [(plain, text is not None and text != plain)]


def test_unify_frame(odd, empty, spark):
    assert unify.unify(odd, ["id"], "t").count() == len(ODD) and unify.unify(empty, ["id"], "t").count() == 0
    t = "é​ﬁ" * 100_000
    r = rows(unify.unify(spark.createDataFrame([(1, t), (1, t)], "id int, t string"), ["id"], "t"))
    assert [x["text_norm"] for x in r] == ["éfi" * 100_000] * 2


# ---- 6 languages

SENTENCES = {
    "en": "The value of the compressor was measured by the group and it is stable.",
    "es": "El valor del compresor fue medido por el grupo y es estable según los datos.",
    "de": "Der Wert des Geräts wurde von der Gruppe gemessen und das ist nicht neu.",
    "fr": "La valeur du compresseur a été mesurée par le groupe et elle est stable dans les cas.",
    "pt": "O valor do compressor foi medido pelo grupo e não é ainda estável segundo os dados.",
}


def test_languages(spark):
    data = [(k, f"{t} {t}", "fr" if k == "en" else k.upper(), "h", "f") for k, t in SENTENCES.items()]
    data += [("mix", SENTENCES["en"] + " " + SENTENCES["de"], "en", "h", "f"), ("none", SENTENCES["es"], None, "h", "f"), ("null", None, "en", "h", "f"), ("empty", "", "en", None, None), ("name", "Xyzzy Plugh", "en", "h", "f"), ("none", SENTENCES["es"], None, "h", "f"), ("nat", SENTENCES["fr"], "français", "h", "f")]
    df = spark.createDataFrame(data, "rec_id string, text string, lang_label string, host string, family string")
    found = langid.identify(df, ["rec_id"], "text", "lang_label", "host", "family")
    got = {(r["rec_id"], r["lang"]): r for r in rows(found)}
    assert set(got) == {(k, k) for k in SENTENCES} | {("mix", "en"), ("mix", "de"), ("none", "es"), ("nat", "fr")}
    assert all(0.5 < r["confidence"] <= 1 for r in got.values())
    cases = {(r["rec_id"], r["lang"]) for r in rows(langid.cases(found, ["rec_id"]))}
    assert cases == {("en", "en"), ("mix", "en"), ("mix", "de"), ("none", "es")}
    assert langid.identify(df.where("false"), ["rec_id"], "text", "lang_label", "host", "family").count() == 0
    parts = {}
    for r in sorted(rows(langid.segments(df.distinct(), ["rec_id"], "text", "lang_label", "host", "family")), key=lambda r: r["segment"]):
        parts.setdefault(r["rec_id"], []).append((r["segment"], r["lang"], r["first_word"], r["last_word"], r["sentences"]))
    en, de = len(SENTENCES["en"].split()), len(SENTENCES["de"].split())
    assert parts["mix"] == [(1, "en", 1, en, 1), (2, "de", en + 1, en + de, 1)] and parts["es"][0][4] == 2 and "null" not in parts
    assert langid.segments(df.where("false"), ["rec_id"], "text", "lang_label", "host", "family").count() == 0
    there = df.withColumn("url", F.lit("https://www.example.de/x"))
    assert {r["lang"] for r in rows(langid.identify(there.where("rec_id = 'de'"), ["rec_id"], "text", "lang_label", "host", "family", "url"))} == {"de"}


def test_held_out_languages(spark, data):
    chunks = spark.read.parquet(f"{data}/chunks.parquet").where("chunk_type = 'text'")
    model = langid.train(chunks, "chunk_id", "text", "lang_label")
    c = langid.Corpus([t for t in SENTENCES.values()], model.memo())
    g, _ = model.score(c)
    assert [langid.LANGS[k] for k in g.argmax(axis=1)] == list(SENTENCES)


# ---- 7 names

ENTRIES = [(1, "person", "Guillermo van Falmousas", "van Falmousas"), (2, "person", "Joseph Niabour", "Niabour"), (3, "person", "Katherine B. Larpranvlind", "Larpranvlind"), (4, "organisation", "Fusdriam Institute for Thermal Loops", None), (5, "person", "Olga Treifiasklen", "Treifiasklen"), (6, "person", "Francisco Treifiasklen", "Treifiasklen")]
FILL = [(100 + i, "person", f"{g} Zz{i:02}kram{i:02}", f"Zz{i:02}kram{i:02}") for i, g in enumerate(["Joseph", "Olga", "Katherine", "Guillermo", "Francisco"] * 14)]


REGISTRY = "author_id bigint, kind string, full_name string, family_name string"


@pytest.fixture(scope="module")
def registry(spark):
    return names.cut(names.entries_of(spark.createDataFrame(ENTRIES + FILL, REGISTRY), "author_id", "full_name", "family_name"))


SPELLED = [("NIABOUR Joseph", 2), ("niabour j.", 2), ("J. Naibour", 2), ("Dr. Joseph  Niabour", 2), ("Niabour, J.", 2), ("Kate Larpranvlind", 3), ("K. B. Larpranvlind", 3), ("G. van Falmousas", 1), ("Guillermo vanFalmousas", 1), ("Fusdriam Inst. for Thermal Loops", 4), ("Institute for Thermal Loops Fusdriam", 4), ("FITLU", 4), ("Paco Treifiasklen", 6), ("Michael Niabour", None), ("Xavier Unknown", None)]


def test_spellings(spark, registry):
    df = spark.createDataFrame([(x,) for x, _ in SPELLED] * 2 + [(None,), ("",)], "name string")
    got = {r["name"]: r["author_id"] for r in rows(names.link(df, "name", registry))}
    assert got == {x: who for x, who in SPELLED if who}


def test_common_family_names_lose_no_bearer(spark):
    given = "Anna Bertram Clara Dolf Erik Fiona Gustav Hedwig Ivo Jonas Klara Lino Mads Nele Otto".split()
    entries = [(k, "person", f"{g} Smith", "Smith") for k, g in enumerate(given)] + [(50 + k, "organisation", f"{a} {b} Group", None) for k, (a, b) in enumerate((x, y) for x in "Alpha Beta Gamma Delta Omega Sigma".split() for y in "Heat Flow Load Ice Wind Loop".split())]
    e = names.cut(names.entries_of(spark.createDataFrame(entries, REGISTRY), "author_id", "full_name", "family_name"))
    spelled = {"Smith, Anna": 0, "Anna Smith": 0, "SMIHT Bertram": 1, "K. Smith": 10, "M. Smith": 12, "Smith": None, "E. Smith": 4, "Gamma Wind Group": 50 + 2 * 6 + 4, "Group Gamma Wind": 50 + 2 * 6 + 4}
    got = {r["name"]: r["author_id"] for r in rows(names.link(spark.createDataFrame([(x,) for x in spelled], "name string"), "name", e))}
    assert got == {x: k for x, k in spelled.items() if k is not None}
    assert names.link(spark.createDataFrame([("Anna Smith",)], "name string"), "name", e.where("false")).count() == 0


def test_common_names_are_met_in_all_spellings(spark):
    given = "Anna Bertram Clara Dolf Erik Fiona Gustav Hedwig Ivo Jonas Klara Bob Liam Sam".split()
    entries = [(k, "person", f"{g} Smith", "Smith") for k, g in enumerate(given)]
    entries += [(50 + k, "person", f"Martin {f}", f) for k, f in enumerate("Abker Bolvin Cedrang Dusch Ekmo Fritje Golub Hasper Imkov Jurba Kelm Lonzo Mirk".split())] + [(70, "person", "Hugo Martin", "Martin")]
    left, right = "Alpha Gamma Delta Omega Sigma Kappa Lambda Theta Zeta Epsilon Iota Upsilon Phi".split(), "Heat Flow Load Ice Wind Turbine Network Quartz Metal Ocean Forest Bridge Sugar".split()
    entries += [(100 + 20 * i + j, "organisation", f"{x} {y} Group", None) for i, x in enumerate(left) for j, y in enumerate(right)]
    e = names.cut(names.entries_of(spark.createDataFrame(entries, REGISTRY), "author_id", "full_name", "family_name"))
    spelled = {"Robert Smith": 11, "Bill Smith": 12, "Tonas Smith": 9, "Smith": None, "de Smith": None, "Smith, S.": 13, "MARTIN": 70, "Group Delta Wind": 144, "Omega Group": None}
    got = {r["name"]: r["author_id"] for r in rows(names.link(spark.createDataFrame([(x,) for x in spelled], "name string"), "name", e))}
    assert got == {x: k for x, k in spelled.items() if k is not None}


def test_name_lists(registry):
    given = names.known_given(registry)
    s = lambda x: names.split_names(x, given)
    assert "joseph" in given
    assert len(s("Joseph Niabour, Olga T. Some, X. Y.")) in (2, 3)
    assert s("Siarkvia, Y. M.; Robert Dreitardes") == ["Siarkvia, Y. M.", "Robert Dreitardes"]
    assert s("A. B. One and C Two & D. Three") == ["A. B. One", "C Two", "D. Three"]
    assert s("") == []


def test_rare_given_names_part_lists_of_a_large_registry(spark):
    many = spark.range(100_000).selectExpr("id + 10 author_id", "'person' kind", "'Anna Zzkram' full_name", "'Zzkram' family_name")
    registry = spark.createDataFrame([(1, "person", "Chidera Niabour", "Niabour"), (2, "person", "Robert Larpranvlind", "Larpranvlind")], REGISTRY).unionByName(many)
    lists = {"p": "Niabour, Chidera, Larpranvlind, Bob", "q": "Niabour, Larpranvlind", "r": "Larpranvlind, Robert; Niabour, Chidera", "s": "Chidera Niabour", "t": None}
    df = spark.createDataFrame([(k, x, None, None) for k, x in lists.items()] * 2, "paper_id string, authors string, year string, citation_key string")
    got = {(r["paper_id"], r["author_pos"], r["author_id"], r["exact"]) for r in rows(names.link_papers(df, "paper_id", "authors", "year", "citation_key", registry))}
    assert got == {("p", 1, 1, False), ("p", 2, 2, False), ("q", 1, 1, False), ("q", 2, 2, False), ("r", 1, 2, False), ("r", 2, 1, False), ("s", 1, 1, True)}


def test_tuned_bands():
    assert names.curve(names.ROWS, names.BANDS, names.LEAST) >= names.RECALL and names.ROWS * names.BANDS <= names.MAX_HASHES


def test_paper_links(spark):
    registry = spark.createDataFrame(ENTRIES + FILL, REGISTRY)
    data = [("p", "Joseph Niabour; Paco Treifiasklen", "1999", "J.Niabour1999", 1), ("p", "Joseph Niabour; Paco Treifiasklen", "1999", "J.Niabour1999", 2), ("q", None, None, None, 1), ("r", "Joseph Niabour", None, "Niabour????", 1)]
    df = spark.createDataFrame(data, "paper_id string, authors string, year string, citation_key string, author_id int")
    got = {(r["paper_id"], r["author_pos"], r["author_id"], r["exact"]) for r in rows(names.link_papers(df, "paper_id", "authors", "year", "citation_key", registry))}
    assert got == {("p", 1, 2, True), ("p", 2, 6, False), ("p", 0, 2, False), ("r", 1, 2, True), ("r", 0, 2, True)}


# ---- 8 packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=12), st.integers(0, 100))
def test_fullest_is_the_best_subset(sizes, room):
    taken = pack.fullest(sizes, room)
    best = max(s for s in {sum(c for k, c in enumerate(sizes) if m >> k & 1) for m in range(1 << len(sizes))} if s <= room)
    assert len(set(taken)) == len(taken) and sum(sizes[i] for i in taken) == best


def test_bins(spark, odd, empty):
    got = rows(pack.pack(odd, "id", "t", 512))
    per = {}
    for r in got:
        per.setdefault(r["bin_id"], []).append(r["part_tokens"])
    assert all(sum(x) <= 512 for x in per.values())
    by_id = {r["id"]: [x for x in got if x["id"] == r["id"]] for r in got}
    assert set(by_id) == {1, 2, 3, 4, 5, None}
    assert all(sum(x["part_tokens"] for x in v) == v[0]["n_tokens"] for v in by_id.values())
    assert by_id[5][0]["n_parts"] == -(-by_id[5][0]["n_tokens"] // 512) and by_id[4][0]["n_parts"] == 1
    assert pack.pack(empty, "id", "t", 512).count() == 0


def test_little_room_is_left():
    rng = random.Random(1)
    sizes = [rng.randrange(20, 900) for _ in range(1500)]
    bins = pack.pack_shard(sizes, 4096)
    used = {}
    for s, b in zip(sizes, bins):
        used[b] = used.get(b, 0) + s
    assert max(used.values()) <= 4096 and len(used) <= -(-sum(sizes) // 4096) + 1


# ---- 9 leakage


def an_item(rng, n=45):
    return " ".join(f"{rng.choice('bcdfgklm')}{rng.choice('aeiou')}{rng.randrange(99)}x" for _ in range(n))


def test_planted_passages(spark):
    rng = random.Random(7)
    items = [(i, an_item(rng)) for i in range(30)]
    docs, want = [], set()
    for k in range(60):
        i = k % 30
        w = items[i][1].split()
        filler = an_item(rng, 60)
        if k < 30:  # at most one word in eight exchanged, in two places
            cut = rng.randrange(12, 33)
            for x in range(rng.randrange(4), 45, 9):
                w[x] = f"other{x}"
            docs.append((k, filler + " " + " ".join(w[:cut]).upper() + " " + filler + " (1) " + ", ".join(w[cut:]) + "."))
            want.add((k, i))
        elif k < 45:  # a quotation of a few words
            docs.append((k, filler + " " + " ".join(w[5:14]) + " " + filler))
        else:  # every second word differs
            docs.append((k, " ".join(x if j % 2 else f"no{j}" for j, x in enumerate(w))))
    df = spark.createDataFrame([*docs, docs[0], (900, None), (901, ""), (902, items[0][1])], "doc_id bigint, text string")
    it = spark.createDataFrame([*items, (99, None), (98, "")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows(leakage.leaked(df, ["doc_id"], "text", it, "item_id", "text"))}
    assert got == want | {(902, 0)}
    assert leakage.leaked(df.where("false"), ["doc_id"], "text", it, "item_id", "text").count() == 0
    assert leakage.leaked(df, ["doc_id"], "text", it.where("false"), "item_id", "text").count() == 0


def test_repetitive_documents_keep_their_second_place(spark):
    w = an_item(random.Random(3), 24).split()
    first, second = w[:12], w[12:]
    second[6] = "other"
    docs = [(1, " . ".join([" ".join(first)] * 80) + " filler words between them all " + " ".join(second)), (2, " . ".join([" ".join(first)] * 80))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame([(5, " ".join(w))], "item_id bigint, text string")
    got = rows(leakage.leaked(df, ["doc_id"], "text", it, "item_id", "text"))
    assert [(r["doc_id"], r["item_id"], r["n_words"], r["places"]) for r in got] == [(1, 5, 23, 2)]


@pytest.mark.parametrize("seed", range(30))
def test_best_places_equal_brute_force(seed):
    rng = random.Random(seed)
    spans = [(a, a + rng.randrange(7, 12), rng.randrange(7, 12), rng.randrange(6)) for a in (rng.randrange(30) for _ in range(7))]
    chains = [[x] for x in sorted(spans)]
    for c in chains:  # grows while it is read
        chains += [[*c, y] for y in sorted(spans) if y > c[-1] and y[0] >= c[-1][1] - 1 and 0 <= y[0] + y[3] - c[-1][1] - c[-1][3] + 1 <= 4]
    size = [sum(x[2] for x in c) for c in chains]
    one = max(size)
    two = max((m + n - max(0, c[-1][1] - e[0][0]) for c, m in zip(chains, size) for e, n in zip(chains, size) if e[0][0] >= c[-1][0] and e[0][1] > c[-1][1]), default=0)
    assert leakage.best_places(spans) == ((two, 2) if two > one else (one, 1))


def test_winnowing_guarantee():
    rng = np.random.default_rng(2)
    for _ in range(200):
        span = rng.integers(1, 50, leakage.K + leakage.W - 1).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(100, 200, 7).astype(np.uint64), span, rng.integers(100, 200, 6).astype(np.uint64)]) for _ in range(2))
        ha, hb = leakage.kgram_hashes(a), leakage.kgram_hashes(b)
        assert set(ha[leakage.winnow(ha)].tolist()) & set(hb[leakage.winnow(hb)].tolist())


def test_every_diagonal_and_place_counts(spark):
    rng = random.Random(5)
    w = an_item(rng, 24).split()
    doc = " . ".join([" ".join(w[:14])] * 70) + " filler words between them " + " ".join(w[12:])
    same = an_item(rng, 52).split()
    swapped = [*same[:12], *(f"no{k}" for k in range(28)), *same[40:]]  # two places on one diagonal
    df = spark.createDataFrame([(1, doc), (2, " ".join(swapped)), (None, doc)], "doc_id bigint, text string")
    it = spark.createDataFrame([("a", " ".join(w)), ("b", " ".join(same)), ("a", "another text of this item that stands nowhere")], "item_id string, text string")
    got = {(r["doc_id"], r["item_id"], r["n_words"], r["places"]) for r in rows(leakage.leaked(df, ["doc_id"], "text", it, "item_id", "text"))}
    assert got == {(1, "a", 24, 2), (None, "a", 24, 2), (2, "b", 24, 2)}


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOOM", 64)
    rng = random.Random(9)
    items = [(i, an_item(rng)) for i in range(8)]
    df = spark.createDataFrame(items, "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows(leakage.leaked(df, ["doc_id"], "text", spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text"))}
    assert got == {(i, i) for i in range(8)}


# ---- 10 subjects

TOPICS = {"law": "statute tribunal plaintiff appeal liability".split(), "sport": "tournament goalkeeper stadium referee coach".split(), "food": "oven flour pastry kitchen recipe".split()}


def a_document(rng, subjects_of):
    out = []
    for s in subjects_of:
        a, b = rng.sample(TOPICS[s], 2)
        out.append(rng.choice([f"The {a} was reported again in the second series with a new {b}.", f"As expected, each {a} follows the summary of the {b} near Xo{rng.randrange(999)}.", f"Only {rng.randrange(60)} of the {a} cases gave a threshold above the {b}."]))
    return " ".join(out)


def test_held_out_subjects(spark):
    rng = random.Random(5)
    docs, labels, truth = [], [], {}
    for k in range(400):
        own = rng.sample(sorted(TOPICS), 2 if k % 5 == 0 else 1)
        docs.append((k, a_document(rng, [own[i * len(own) // 8] for i in range(8)])))
        truth[k] = set(own)
        if k < 200:
            labels += [(k, s) for s in own] if k % 25 else [(k, rng.choice(sorted(TOPICS)))]
    df = spark.createDataFrame([*docs, (900, None), (901, ""), docs[0]], "doc_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string")
    models = subjects.train(subjects.labelled_rows(df, "doc_id", "text", lab, "subject"), sorted(TOPICS))
    got = {}
    for r in rows(subjects.classify(df, ["doc_id"], "text", models)):
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert sum(got.get(k) == truth[k] for k in range(200, 400)) >= 190
    assert 900 not in got and 901 not in got
    assert subjects.classify(df, ["doc_id"], "text", None).count() == 0
    assert subjects.train([], ["law"]) is None
    assert subjects.classify(df.where("false"), ["doc_id"], "text", models).count() == 0


# ---- the queries


@pytest.mark.parametrize("n", range(1, 11))
def test_found_queries_run(spark, data, n):
    from foliant.llm.queries import QUERIES

    df = QUERIES[f"p{n}_found"](spark, data)
    want = {1: "rec_kind rec_id page_num noise token", 2: "chunk_id", 3: "rec_kind id_a id_b", 4: "chunk_id kind", 5: "rec_kind rec_id", 6: "rec_kind rec_id lang", 7: "paper_id author_pos author_id", 8: "doc_id", 9: "doc_id item_id", 10: "doc_id subject"}
    assert df.columns == want[n].split()
    got = df.collect()
    assert len(got) == len(set(got)) and (got or n in (8, 9))


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parents[2] / "foliant"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"foliant[.]llm|from [.]+llm", p.read_text()), p
    assert unicodedata.unidata_version

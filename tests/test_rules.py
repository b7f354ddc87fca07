"""Rules of single operators on literal rows: mail, recognised text, ranks, markup, labels."""

from pyspark.sql import functions as F

from textquarry.functions.markup import strip_html
from textquarry.functions.ranks import running
from textquarry.operators import cleanup as K
from textquarry.operators import compare as C
from textquarry.operators import conversations as V
from textquarry.operators import feeds as E
from textquarry.operators import marks as M
from textquarry.operators import pages as P
from textquarry.operators import search as S
from textquarry.sources import files as X


def test_mail_of_any_charset(spark, tmp_path):
    head = b"From a@b.c Thu Jan  1 00:00:00 1970\nSubject: =?utf-8?q?Citt=C3=A0?=\nContent-Type: text/plain; charset=%s\nContent-Transfer-Encoding: %s\n\n"
    bodies = [(b"utf-8", b"8bit", "Città è 你".encode()), (b"iso-8859-1", b"8bit", "Città è".encode("latin-1")), (b"utf-8", b"quoted-printable", b"Citt=C3=A0 =\n=C3=A8"), (b"no-such", b"8bit", "Città".encode())]
    box = b"\n".join(head % (c, t) + body + b"\n" for c, t, body in bodies) + b"\nFrom x\nSubject: nudo\n\n" + "però".encode("latin-1") + b"\n"
    (tmp_path / "a.mbox").write_bytes(box)
    rows = X.read_mailbox(spark, f"{tmp_path}/a.mbox").orderBy("pos").collect()
    assert [r["text"].strip() for r in rows] == ["Città è 你", "Città è", "Città è", "Città", "però"]
    assert rows[0]["subject"] == "Città" and rows[4]["subject"] == "nudo"
    one = b"Subject: s\nContent-Type: multipart/mixed; boundary=x\n\n--x\nContent-Type: text/plain; charset=latin-1\n\n" + "è".encode("latin-1") + b"\n--x\nContent-Disposition: attachment; filename=a.pdf\n\n%PDF-1\n--x--\n"
    (tmp_path / "b.eml").write_bytes(one)
    row = X.read_mailbox(spark, f"{tmp_path}/b.eml").first()
    assert (row["text"].strip(), row["attachments"], row["n_pdf"]) == ("è", ["a.pdf"], 1)


def test_repaired_tokens_keep_the_rest(spark):
    docs = spark.createDataFrame([(1, "A  tr4sh, (TR4SH) here:\tworth less!\nHsart. Tr4sh-x"), (2, None)], "doc int, text string")
    rows = {r["doc"]: r["text"] for r in K.repair_tokens(docs, "doc", ["trash", "worthless"]).collect()}
    assert rows == {1: "A  trash, (TRASH) here:\tworthless!\nTrash. Trash-x", 2: ""}


def test_candidate_scores(spark):
    rows = spark.createDataFrame([("Totale 1234,50 euro",), ("Totale ,,, euro",), ("12 34",)], "t string").select("t", K.candidate_score(F.col("t"), F.lit(False)).alias("s")).collect()
    scores = {r["t"]: r["s"] for r in rows}
    assert scores["Totale 1234,50 euro"] == 10 * 10 / 11 + 2 * 3  # digits count as neither letters nor other signs
    assert scores["Totale ,,, euro"] == 10 * 10 / 13 + 2 * 3
    assert scores["12 34"] == -0.5


def test_best_candidates(spark):
    rows = [(1, 0, "hello"), (1, 1, "hello world and more"), (1, 2, "Hello  world"), (2, 0, "un titolo lungo"), (2, 1, "firma in fondo"), (3, 0, "abcdefghijklmnop"), (3, 1, "abcdefghijklmnopqr"), (4, 0, " ")]
    got = {r["item"]: r["text"] for r in K.best_candidate(spark.createDataFrame(rows, "item int, no int, text string"), "item", [], order_col="no").collect()}
    assert got == {1: "hello world and more", 2: "un titolo lungo\nfirma in fondo", 3: "abcdefghijklmnop"}
    hints = K.best_candidate(spark.createDataFrame([(1, 0, "tanto testo lungo e ben leggibile"), (1, 1, "compleanno")], "item int, no int, text string"), "item", ["compleanno"], order_col="no").first()
    assert "compleanno" in hints["text"]


def test_reading_order_without_heights(spark):
    # the middle gap is 30, so a height of 21 is guessed, and words up to 13.65 apart are one row
    def lines(*ys):
        boxes = spark.createDataFrame([(1, c, float(i), float(y)) for i, (c, y) in enumerate(zip("abcde", ys, strict=True))], "page_id long, t string, x double, y double").withColumns({"w": F.lit(1.0), "h": F.lit(None).cast("double")})
        return [r["line"] for r in K.reading_order(boxes).orderBy("line_no").collect()]

    assert lines(0, 18, 48, 78, 108) == ["a", "b", "c", "d", "e"]
    assert lines(0, 13, 43, 73, 103) == ["a b", "c", "d", "e"]


def test_running_sums_of_a_large_group(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, None).otherwise("hot").alias("k"), (F.col("id") * 7 % 2000).alias("at"), (F.col("id") % 5).alias("v"))
    got = sorted((r["k"] or "", r["at"], r["sum"]) for r in running(rows, ["k"], "at", F.col("v"), "sum", cell=100).collect())
    sums, want = {}, []
    for k, at, v in sorted((r["k"] or "", r["at"], r["v"]) for r in rows.collect()):
        want.append((k, at, sums.get(k, 0)))
        sums[k] = sums.get(k, 0) + v
    assert got == want


def test_markup(spark):
    page = spark.createDataFrame([("<p>Uno &amp; due</p>tre<br>\n quattro <b>x</b></div> ",)], "h string").select(strip_html(F.col("h")).alias("p"), strip_html(F.col("h"), blocks=False).alias("t")).first()
    assert page["p"] == ["Uno & due", "tre", "quattro x"] and page["t"] == "Uno & duetre quattro x"


def test_clauses_keep_abbreviations(spark):
    text = "La Rossi S.p.A. vende. Poi S.r.l. tace; vale 3.5! 12 1) fine - "
    row = spark.createDataFrame([(text,)], "t string").select(C.clauses(F.col("t")).alias("c")).first()
    assert row["c"] == ["La Rossi S.p.A. vende.", "Poi S.r.l. tace;", "vale 3.5!", "1) fine"]


def test_posts(spark):
    rows = [('Nome on X: "un testo di prova / lungo"', "un testo di prova lungo"), ("log in to see this page", ""), ("https://example.org/abcdef", ""), ("Nome Cognome on X", ""), ("corto", ""), ("«una frase che va bene»", "una frase che va bene")]
    got = spark.createDataFrame(rows, "t string, want string").select("want", P.post_piece(F.col("t")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)
    page = '<title>Titolo della pagina qui</title><meta name="description" content="Una descrizione abbastanza lunga">'
    row = spark.createDataFrame([(page,)], "h string").select(P.post_text(F.col("h")).alias("p"), P.sharing_title(F.col("h")).alias("t")).first()
    assert tuple(row) == ("Una descrizione abbastanza lunga", "Titolo della pagina qui")


def test_labels_and_lists(spark):
    rows = spark.createDataFrame([(1, ["Cane", "gatto"]), (2, ["cane"])], "id int, labels array<string>")
    assert [r["id"] for r in K.match_labels(rows, "labels", ["CANE", "gatto"]).collect()] == [1]
    hits = spark.createDataFrame([("b", "2024-01-01"), ("A", "2024-01-02"), ("c", None)], "name string, d string").withColumn("date", F.col("d").cast("timestamp"))
    order = {m: [r["name"] for r in S.sort_results(hits, m, "date", "name").collect()] for m in ("newest", "oldest", "name")}
    assert order == {"newest": ["A", "b", "c"], "oldest": ["b", "A", "c"] if order["oldest"][0] == "b" else ["c", "b", "A"], "name": ["A", "b", "c"]}


def test_profiles_find_terms_within_words(spark):
    docs = spark.createDataFrame([(1, "Il GATTO e il cane", "it"), (2, "gattopardo", "it"), (3, None, "it")], "doc_id long, text string, lang string")
    profiles = spark.createDataFrame([("p", ["gatto", "CANE"], None), ("q", ["gatto", "gatto"], "it"), ("r", ["gatto"], "en"), ("s", [], None)], "name string, terms array<string>, profile_lang string")
    want = {("p", 1), ("q", 1), ("q", 2)}
    for most in (1, 1000):
        assert {(r["name"], r["doc_id"]) for r in S.run_profiles(docs, profiles, most=most).collect()} == want
    assert S.run_profiles(docs, profiles.limit(0)).count() == 0


def test_addresses_of_feeds(spark):
    rows = spark.createDataFrame([("../a", "http://h/x/y/z"), ("javascript:x()", "http://h/"), ("mailto:a@b.c", "http://h/"), ("foo:bar", "http://h/")], "u string, b string")
    assert [r["u"] for r in E.resolve_uris(rows, "u", "b").collect()] == ["http://h/x/a", "", "mailto:a@b.c", ""]


def test_slices_by_question(spark):
    docs = spark.createDataFrame([(1, "x" * 300 + "Il capitolo secondo parla di mare. " + "y" * 50), (2, "corto")], "doc int, text string")
    outline = spark.createDataFrame([(1, "Il capitolo secondo", 7)], "doc int, title string, page int")
    ask = lambda q: V.focus_slice(docs, outline, spark.createDataFrame([(1, q), (2, q)], "doc int, question string"), "doc", 100, 40).collect()
    assert [r["slice"] for r in ask("che dice pagina 7?")] == ["Il capitolo secondo parla di mare. yyyyy"]
    assert [r["slice"] for r in ask("parla di IL CAPITOLO SECONDO")] == ["Il capitolo secondo parla di mare. yyyyy"]
    assert ask("altro") == []


def test_digests(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "model", "b"), (1, 2, "system", "z"), (2, 0, "user", "a"), (2, 1, "model", "b")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    heads = spark.createDataFrame([(1, "t"), (2, "t"), (3, "t")], "conv_id long, title string")
    digests = {r["conv_id"]: r["digest"] for r in V.content_digest(table, heads).collect()}
    assert digests[1] == digests[2] != digests[3] and len(digests[1]) == 64
    assert V.content_digest(table.where("turn = 0"), heads).where("conv_id = 1").first()["digest"] != digests[1]


def test_marks_of_media(spark):
    marks = spark.createDataFrame([("m", "1", 5.0, "uno", True), ("m", "2", 9.0, "due", False), ("m", "3", 7.0, "tre", False)], "media string, id string, sec double, name string, is_resume boolean")
    named = M.rename_media_mark(marks, spark.createDataFrame([("m", "1", " nuovo "), ("m", "2", "  ")], "media string, id string, new_name string"))
    assert {r["id"]: r["name"] for r in named.collect()} == {"1": "nuovo", "2": "due", "3": "tre"}
    left = M.delete_media_marks(marks, spark.createDataFrame([("m", "1")], "media string, id string"))
    assert {r["id"]: r["is_resume"] for r in left.collect()} == {"2": True, "3": False}


def plain_marks(rows):
    """Marks after new ones, document by document, by the rules as they are written."""

    def excerpt(text, at):
        at = max(0, min(at, len(text)))
        line = text[text.rfind("\n", 0, at) + 1 : at] + text[at:].split("\n", 1)[0]
        if not line.split() and at < len(text):
            line = text[at : at + 90]
        flat = " ".join(line.split())
        return flat[:89].rstrip() + "…" if len(flat) > 90 else flat

    def place(text, pos, anchor, prefix):
        if not text:
            return 0
        if text[pos : pos + len(anchor)] == anchor and pos <= len(text):
            return pos
        hits, at = [], text.find(anchor)
        while at >= 0 and len(hits) < 12:
            hits.append(at)
            at = text.find(anchor, at + 1)
        behind = [h for h in hits if prefix and text[max(h - len(prefix), 0) : h] == prefix]
        return behind[0] if behind else min(hits, key=lambda h: (abs(h - pos), h)) if hits else max(0, min(pos, len(text)))

    out = []
    for doc, old in rows:
        now = "Nuova riga.\n" + old if doc % 2 == 0 else old[::-1] if doc % 7 == 0 else old
        pos = len(old) // 3
        at = place(now, pos, old[pos : pos + 20], old[max(pos - 10, 0) : pos])
        marks = [{"id": str(doc), "pos": pos, "place": at, "text": excerpt(now, at) if now else "", "resume": True, "status": "old"}]
        for p in sorted([0, len(now) // 3, len(now) // 2]):
            same = next((m for m in marks if m["text"] and m["text"] == excerpt(now, p) or abs(m["place"] - p) <= 15), None)
            if same is None:
                same = {"id": str(max(int(m["id"]) for m in marks) + 1), "pos": p, "place": p, "text": excerpt(now, p), "status": "added"}
                marks.append(same)
            elif same["status"] == "old":
                same["status"] = "already"
            for m in marks:
                m["resume"] = m is same
        out += [(str(doc), m["id"], m["pos"], m["place"], m["resume"], m["status"]) for m in marks]
    return sorted(out)


def test_added_marks_against_plain_ones(spark):
    from textquarry import plans

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = plans.QUERIES["mrk3_add_marks"](spark, d).collect()
    assert sorted((r["doc_key"], r["id"], r["pos"], r["place"], r["is_resume"], r["status"]) for r in got) == plain_marks(rows)


def test_merging_marks_three_times(spark):
    from textquarry.operators import marks as M

    schema = "doc_key int, id string, pos int, anchor string, is_resume boolean"
    store = lambda *rows: spark.createDataFrame([(1, i, p, "a", False) for i, p in rows], schema)
    told = lambda df: sorted((r["id"], r["pos"]) for r in df.collect())
    ours = store(("7", 10), ("7-altra-2", 15))
    for pos in (20, 30, 40):
        ours = spark.createDataFrame(M.merge_marks(ours, store(("7", pos))).collect(), schema)
    want = [("7", 10), ("7-altra-1", 20), ("7-altra-2", 15), ("7-altra-3", 30), ("7-altra-4", 40)]
    assert told(ours) == want
    for again in (("7", 10), ("7", 30), ("7-altra-2", 15)):
        assert told(M.merge_marks(ours, store(again))) == want
    assert told(M.merge_marks(store(("7", 10)), store(("7", 20), ("7-altra-1", 50), ("8", 10)))) == [("7", 10), ("7-altra-1", 50), ("7-altra-2", 20), ("8", 10)]
    assert told(M.merge_marks(store(*[(str(k), k) for k in range(150)]), store(("200", 999)), most=None)) == sorted([(str(k), k) for k in range(150)] + [("200", 999)])


def test_digests_tell_files_and_chosen_titles_apart(spark):
    from textquarry.operators import conversations as V

    turns = spark.createDataFrame([(k, 0, "user", "ciao") for k in range(5)], "conv_id int, turn int, role string, text string")
    headers = spark.createDataFrame([(k, "t", k == 1) for k in range(5)], "conv_id int, title string, title_custom boolean")
    files = spark.createDataFrame([(2, 0, "a", "x"), (2, 1, "b", "y"), (3, 0, "b", "y"), (3, 1, "a", "x")], "conv_id int, pos int, path string, title string")
    rows = {r["conv_id"]: r["digest"] for r in V.content_digest(turns, headers, files).collect()}
    assert len({*rows.values()}) == 4 and rows[0] == rows[4]
    assert len({r["digest"] for r in V.content_digest(turns, headers.drop("title_custom")).collect()}) == 1

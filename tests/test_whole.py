"""Queries that do the whole job, on rows that a cut would leave out."""

from textquarry import plans


def folder(path, **tables):
    for name, frame in tables.items():
        frame.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_fold_takes_sharp_s(spark, tmp_path):
    from hashlib import md5

    d = folder(tmp_path, documents=spark.createDataFrame([(1, "Große Straße"), (2, "Caffè")], "doc_id long, text string"))
    rows = {r["doc_id"]: (r["folded"], r["sign"]) for r in plans.QUERIES["fn4_fold"](spark, d).collect()}
    want = {1: ("grosse strasse", "großestraße"), 2: ("caffe", "caffe")}
    assert rows == {k: tuple(md5(x.encode()).hexdigest() for x in v) for k, v in want.items()}


def test_links_take_sharp_s(spark, tmp_path):
    d = folder(tmp_path, conversations=spark.createDataFrame([(1, 0, "Große Straße"), (1, 1, "Maß"), (1, 2, "Ende"), (1, 3, "Fuß")], "conv_id long, turn long, text string"))
    rows = {r["pos"]: r["target"] for r in plans.QUERIES["doc4_resolve_internal_links"](spark, d).collect()}
    assert rows == {0: "GROSSE STRASSE", 1: "Maß", 2: "ENDE", 3: None}


def test_reflow_takes_the_whole_text(spark, tmp_path):
    text = " ".join(f"parola{i}" for i in range(40))
    d = folder(tmp_path, documents=spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert plans.QUERIES["ocr2_reflow_vertical"](spark, d).first()["text"] == text.replace(" ", "\n\n")


def test_headings_of_all_lines(spark, tmp_path):
    text = "\n".join(f"Capitolo {i:02d}" for i in range(45))
    d = folder(tmp_path, documents=spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert plans.QUERIES["doc3_annotate_headings"](spark, d).first()["headings"] == 45


def test_all_phrases_are_restored(spark, tmp_path):
    """A phrase beyond the 200th by alphabet is glued and restored; all texts are as a plain chain over all phrases makes them."""
    import re
    from hashlib import md5

    passages = [f"a{i:03d} parola fine" for i in range(230)] + ["zeta\u00a0x ultima fine", "zeta ultima fine", "zeta $ul fine", "ab c", "a b", "zetaultima ok\\d x", "", "solo", " zeta x"]
    texts = ["dice zeta\nultima qui", "zetaultima", "uno zeta ultima, due", "a b c a\nb", "(a229parola) a229\nparola", "zetaultima ok\\d", "zeta\n$ul", "zeta\u00a0x\nultima", "niente", "", None]
    d = folder(tmp_path, documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), benchmark=spark.createDataFrame(list(enumerate(passages)), "item_id long, text string"))
    phrases = sorted({" ".join(re.split(r"[ \t\n\x0b\f\r]+", p)[:2]) for p in passages})

    def plain(t):
        for p in phrases:
            t = t.replace(p, p.replace(" ", "")) if p else t
        for p in sorted((p for p in phrases if len(p.split()) > 1), key=lambda p: (-len(p), p)):
            t = re.sub(r"(?<![^\W\d_])" + r"[ \t\n\x0b\f\r]?".join(map(re.escape, p.split())) + r"(?![^\W\d_])", lambda _, p=p: " ".join(p.split()), t)
        return t

    rows = {r["doc_id"]: r["text_md5"] for r in plans.QUERIES["doc2_restore_spaces"](spark, d).collect()}
    assert rows == {i: t if t is None else md5(plain(t).encode()).hexdigest() for i, t in enumerate(texts)}
    assert plain(texts[4]) == "(a229 parola) a229 parola"


def test_profiles_of_any_number(spark, tmp_path):
    from textquarry.operators import search as S
    from textquarry.streaming import arrivals as A

    docs = spark.createDataFrame([(1, "parola zeta", "it"), (2, "parola", "en"), (3, "altro", "it")], "doc_id long, text string, lang string")
    profiles = spark.createDataFrame([(f"p{i % 1005}", ["parola"], None) for i in range(1007)] + [("z", ["ZETA"], "it"), ("e", [], None)], "name string, terms array<string>, profile_lang string")
    want = sorted([(f"p{i % 1005}", k) for i in range(1007) for k in (1, 2)] + [("z", 1)])
    assert sorted((r["name"], r["doc_id"]) for r in S.run_profiles(docs, profiles).collect()) == want
    docs.write.parquet(f"{tmp_path}/in")
    found = A.standing_search(A.arrivals(spark, f"{tmp_path}/in", docs.schema), profiles.drop("profile_lang"), ["doc_id"])
    A.to_parquet(found, f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    assert sorted((r["name"], r["doc_id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want


def test_glossary_of_any_number(spark, tmp_path):
    from hashlib import md5

    d = folder(tmp_path, documents=spark.createDataFrame([(1, "dice W10004, qui"), (None, "w00000"), (1, "niente"), (4, "the W00001"), (5, None)], "doc_id long, text string"), benchmark=spark.range(10_005).selectExpr("id AS item_id", "format_string('w%05d %s', id, if(id = 1, 'taht', 'xy')) AS text"))
    rows = {(r["doc_id"], r["text_md5"]) for r in plans.QUERIES["sea6_apply_glossary"](spark, d).collect()}
    assert rows == {(k, md5(t.encode()).hexdigest()) for k, t in ((1, "dice yx, qui"), (None, "yx"), (4, "the that"))}
    assert [tuple(r) for r in plans.QUERIES["sea7_match_with_glossary"](spark, d).collect()] == [(4, True)]

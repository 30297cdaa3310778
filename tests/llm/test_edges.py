"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for each operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heronlake.llm import best_fit_packing, chat_format, language_id, line_dedup, media_copies, piece_codec, quality_classifier, quality_rules, simhash_neardup, url_filters

LONG = " ".join(f"word{i} of the long text" for i in range(40_000)) + "."
PROSE = "this is a plain text about nothing at all, and it has the words that such a text has, one after the other, until it ends here."
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _text string, site string, h1 string, fp string, line string, piece string, gone string, word string, n_words string"
X = ("x",) * 10
ROWS = [(1, None, None, None, None, *X), (2, "", "en", "a", 0, *X), (3, PROSE, "en", "a", 1, *X), (3, PROSE, "en", "a", 1, *X), (4, PROSE, "en", None, 1, *X), (5, LONG, "en", "b", 1, *X), (6, " \n\t\n", "de", "c", 1, *X), (None, "no id", "de", "c", 1, *X), (7, "日本語 ¿ß? 😀", "de", "c", 1, *X)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_rules(docs, none):
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    assert len(quality_rules.judged(docs).collect()) == len(ROWS) and quality_rules.judged(none).count() == 0
    assert got[3].kept and not got[1].kept and not got[2].kept and got[5].n_words == 200_000 and got[7].n_words == 3
    assert {"site", "word", "line"} <= set(quality_rules.judged(docs).columns)


def test_language(docs, none):
    p = language_id.learn(docs, F.lit(True))
    got = {r.doc_id: r for r in language_id.predict(docs, p).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[6].lang_pred == "und" and got[3].lang_pred == "en" and got[2].score == 0
    assert language_id.predict(docs, language_id.learn(none, F.lit(True))).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(none, p).count() == 0 and language_id.keep(docs, p, 0.0).columns == docs.columns


def test_simhash(docs, none):
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash_neardup.near_duplicates(docs).collect()]
    by = {d: (f, c) for d, f, c in got}
    assert len(got) == len(ROWS) and by[1] == by[2] == by[6] == (0, 1) and by[3][1] == by[4][1] == 3
    assert simhash_neardup.near_duplicates(none).count() == 0


def test_line_dedup(docs, none):
    got = {r.doc_id: r for r in line_dedup.dedup(docs, min_sites=1).collect()}
    assert got[1].clean_text is None and got[1].n_lines == 0 and got[2].clean_text == "" and got[4].clean_text == "" and got[3].clean_text == PROSE
    assert line_dedup.dedup(docs).where("n_removed > 0").count() == 0 and line_dedup.dedup(none).count() == 0


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = best_fit_packing.pack_documents(docs, path, 256).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, 7, None} and sum(r.doc_id == 1 for r in got) == 1
    assert sum(r.length for r in got if r.doc_id in (1, 2, 6)) == 3
    spans = {}
    for r in got:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256
    assert best_fit_packing.pack_documents(none, path).count() == 0


def test_urls(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "no scheme", "a"), (4, "http://SPAM.Bad.org/x?y", "a"), (4, "http://SPAM.Bad.org/x?y", "a"), (5, "https://good.org#t", "a"), (6, "x://www.example.com/en/1", "a"), (7, "x://" + "a." * 300 + "bad.org", "a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    listed = spark.createDataFrame([("bad.org",), ("bad.org",), (None,), ("unseen.org",)], "key string")
    got = {r.page_id: r for r in url_filters.judge(pages, listed, url_filters.RULES).collect()}
    assert (got[1].host, got[1].path, got[1].verdict) == ("", "", "allow") and got[3].host == ""
    assert got[4].verdict == got[7].verdict == "block" and got[4].host == "spam.bad.org" and got[5].path == "" and got[5].verdict == "allow"
    assert (got[6].rule, got[6].verdict) == ("www.example.com/en/", "allow")
    assert url_filters.judge(pages.limit(0), listed, url_filters.RULES).count() == 0
    assert url_filters.judge(pages, listed.limit(0), url_filters.RULES).where("verdict = 'block'").count() == 0


def test_media(spark):
    a = media_copies.render([i * 0.01 * (-1) ** i for i in range(64)])
    rows = [(50, a, "x"), (1, a, "x"), (1, a, "x"), (2, None, "x"), (100, b"", "x"), (3, b"junk", "x"), (4, media_copies.render(None), "x")]
    m = spark.createDataFrame(rows, "id long, media binary, keys string")
    got = sorted((r.id, r.class_id, r.class_size) for r in media_copies.Copies(m).classes.collect())
    assert got == [(1, 1, 3), (1, 1, 3), (2, 2, 1), (3, 3, 1), (4, 4, 1), (50, 1, 3), (100, 100, 1)]
    assert media_copies.Copies(m.limit(0)).classes.count() == 0


def test_classifier(spark, docs, none):
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 1), (2, 0), (1, None), (99, 1)], "doc_id long, label int")
    model = quality_classifier.train(docs.select("doc_id", "text"), labels, F.lit(True))
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    assert len(got) == 8 and all(0 <= s <= 1 for s in got.values()) and got[1] == got[2]
    blank = quality_classifier.train(docs.select("doc_id", "text"), labels, F.lit(False))
    assert {r.score for r in quality_classifier.score(docs, blank).collect()} == {0.5} and quality_classifier.score(none, model).count() == 0


def test_codec(docs, none):
    got = {r.doc_id: r for r in piece_codec.encode_column(docs, "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert got[1].ids == got[2].ids == [] and got[1].decoded == "" and got[5].decoded == LONG and got[7].decoded == ROWS[8][1]
    assert piece_codec.digest_column(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_chat(spark):
    text = "<s> [ROLE] <\\/s> </s>"
    rows = [(1, 0, "user", text), (1, 1, "assistant", None), (1, 1, "assistant", ""), (2, 0, None, None), (None, 0, "user", "a"), (3, None, "assistant", "x" * 100_000)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.tree: chat_format.parse(r.formatted) for r in chat_format.format_branches(chat_format.chain(c)).collect()}
    assert got == {1: [("user", text), ("assistant", ""), ("assistant", "")], 2: [("", "")], None: [("user", "a")], 3: [("assistant", "x" * 100_000)]}
    assert chat_format.format_branches(chat_format.chain(c.limit(0))).count() == 0


def test_stages(spark, docs, none, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= len(ROWS), name
        assert stage(spark, none, str(tmp_path)).count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, str(tmp_path)).select("doc_id").distinct().collect() if r.doc_id) == [1, 3, 5, 7]


#: Names that operators and stages use inside.
INNER = ("row", "document", "same", "key", "node", "best", "fp", "keys", "root", "cell", "salt", "rank", "lang_pred", "score", "clean_text", "base_failed", "a", "b")


def test_stages_keep_columns_with_inner_names(spark, tmp_path):
    """Every stage but the last returns such columns with the values they had."""
    prose = [f"{PROSE} And this is the text number {k} of them, which has words of its own: {' '.join(f'w{k}x{j}' for j in range(30))}." for k in range(4)]
    rows = [(k, t, "en", f"s{k}", len(t), *(f"{c}-{k}" for c in INNER)) for k, t in enumerate(prose)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in INNER))
    given.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, str(tmp_path))
        assert out.columns == given.columns, name
        assert sorted(tuple(r) for r in out.drop("text", "n_chars").collect()) == sorted(tuple(r) for r in given.drop("text", "n_chars").collect()), name


def test_a_phrase_in_a_long_line_removes_nothing(spark):
    """A one-line text of hundreds of words that mentions cookies once is prose; a short line that does is boilerplate."""
    prose = " ".join(f"the {w} of day {k} were v{k} good and we x{k} ate y{k} them." for k, w in enumerate(["cakes"] * 30 + ["cookies"] + ["pies"] * 30))
    rows = [(1, prose, "", "", 0), (2, f"{prose}\nWe use cookies here.", "", "", 0)]
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got[1].kept and got[1].clean_text == prose and got[2].kept and got[2].clean_text == prose


def test_table_of_tokens_is_bounded_by_bytes(monkeypatch):
    hasher, plain = quality_classifier.Hasher(), quality_classifier.Hasher()
    monkeypatch.setattr(quality_classifier, "MAX_BYTES", 5_000)
    for k in range(200):
        text = " ".join(f"token{k}x{j}" for j in range(20)) + " " + "y" * 100_000
        assert hasher.features(text).tolist() == plain.features(text).tolist()
        assert sum(map(len, hasher.known)) < 5_000 and max(map(len, hasher.known)) <= quality_classifier.LONG


def test_rows_without_an_id_are_in_no_fold(spark, tmp_path):
    docs = spark.createDataFrame([(None, PROSE, "en", "a", 1), *((k, f"{PROSE} {k}", "en", "a", 1) for k in range(12))], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, 1, 0), (2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for query in (language_id.op2_language_id, quality_classifier.op8_quality_classifier):
        got = {r.doc_id: r.held_out for r in query(spark, str(tmp_path)).collect()}
        assert len(got) == 13 and got[None] is False and set(got.values()) == {True, False}


def test_repeated_ids_are_learnt_once(spark):
    once = spark.createDataFrame([(1, "aa bb", "x"), (2, "cc", "y")], "doc_id long, text string, lang string")
    twice = once.unionByName(spark.createDataFrame([(1, "zz zz zz zz", "x")] * 50, once.schema))
    a, b = (language_id.learn(d, F.lit(True)) for d in (once, twice))
    assert language_id.predict(once, a).collect() == language_id.predict(once, b).collect()


def test_texts_that_are_not_utf8_pass_all_stages(spark, tmp_path):
    """Parquet doesn't check strings: bytes that Python can't decode stop neither the language stage nor its learning, and come back as U+FFFD."""
    rows = [(k, (f"{PROSE} part {k}").encode() + tail, b"en", b"a\xff") for k, tail in enumerate([b".", b" caf\xe9 ends.", b" half \xed\xa0\x80 pair ends.", b" cut \xf0\x9f\x98"])]
    docs = spark.createDataFrame(rows, "doc_id long, text binary, lang binary, source binary").select("doc_id", *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") == 1, F.unhex(F.lit("FE")).cast("string")).otherwise(F.col("lang")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert df.where("not is_valid_utf8(text)").count() == 3
    for _, stage in corpus_pipeline.STAGES[:3]:
        df = stage(spark, df, str(tmp_path))
    got = {r.doc_id: r for r in df.select("doc_id", "text", F.hex("source").alias("source")).collect()}
    assert sorted(got) == [0, 1, 2, 3] and got[1].text == f"{PROSE} part 1 caf� ends." and "�" in got[2].text and "�" in got[3].text
    assert {r.source for r in got.values()} == {"61FF"}  # columns that no stage reads stay as they are
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} <= set(got)

import json
import os

import pytest
from pyspark.sql import functions as F

from analystry.functions import text as T
from analystry.operators.columns import cast_with_rejects
from analystry.plans import archive as A
from analystry.plans import city_table as C
from analystry.sources import files as S
from analystry.sources.html import html_table


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("value,expression,want", [
    ("the then to a wonderful", T.obfuscate_words, "tXXe thXXn XXo a woXXl"),
    ("ação é", T.mask_word_characters, "xxxx x"),
    ("  a b\t\n", T.strip_spaces, "a b"),
    ("a  b c\n\n d", T.drop_long_spaces, "ab cd"),
    ("1.059,46", T.brazilian_number, "1059.46"),
    ("a &lt;b&gt; &amp;lt; &#233;&#8364;", T.html_unescape, "a <b> &lt; é€"),
    ("&#128512; &#x1F600; &Eacute;&hearts;&nbsp;&#0;&#x110000;&notit; &bogus;", T.html_unescape, "😀 😀 É♥\xa0\ufffd\ufffd¬it; &bogus;"),
    ('<tr class="a 1"><td class="b">', T.drop_class_attribute, "<tr><td>"),
    ("x" * 81, T.trim_to, "x" * 77 + "..."),
    ("x" * 80, T.trim_to, "x" * 80),
    ("http://e.org/a/b.jpg?x=1#f", T.url_file, "b.jpg"),
    ("A: b\n\nhi\n> q\nX wrote:\nthere\n--\nme", T.strip_message, "hi\nthere"),
])
def test_scalar_functions(spark, value, expression, want):
    assert one(spark, value, expression) == want


def test_missing_marker_gives_null(spark):
    assert one(spark, "abc", lambda c: T.between_markers(c, "<tbody", "</tbody>")) is None
    assert one(spark, None, T.strip_spaces) is None
    assert one(spark, "", lambda c: T.first_number(F.array(c))) is None


def test_character_ngrams(spark):
    grams = lambda c: T.char_ngrams(c, 2, 3)
    assert one(spark, "abcde", grams) == ["ab", "abc", "bc", "bcd", "cd", "cde"]
    assert one(spark, "ab", grams) == []
    assert one(spark, "", grams) == []
    assert one(spark, "a\U0001F600b", lambda c: T.all_char_ngrams(c, 2, 3)) == ["a\U0001F600", "\U0001F600b", "a\U0001F600b"]
    assert one(spark, "ab", lambda c: T.all_char_ngrams(c, 2, 5)) == ["ab"]


def test_word_ngrams(spark):
    got = one(spark, "Été x no más", lambda c: T.word_ngrams(T.word_tokens(c), 1, 2))
    assert got == ["Été", "no", "más", "Été no", "no más"]


def test_jsonp(spark):
    page = 'var blog_api_answer = {"posts":[{"slug":"x"}]};'
    df = spark.createDataFrame([(page,)], "body string")
    assert [r["slug"] for r in A.posts_of(df, "body").collect()] == ["x"]


def test_html_table_with_header_and_empty_row(spark):
    page = ('<table><tbody class="a"><tr><td>Belém</td><td>1.452.275</td><td>1.059,46</td></tr><tr></tr>'
            "<tr><td>S. Luís</td></tr></tbody></table>")
    rows = html_table(spark.createDataFrame([(page,)], "h string"), "h", ["a", "b", "c"]).orderBy("row_no").collect()
    assert [(r["a"], r["b"], r["c"]) for r in rows] == [("Belém", "1.452.275", "1.059,46"), ("S. Luís", None, None)]


def test_city_table_types_and_rejects(spark):
    cells = "".join(f"<td>{v}</td>" for v in ["S. Luís", "12", "g", "1.452.275", "1.059,46", "1,5", "9,25"])
    bad = cells.replace("1.452.275", "muitos")
    page = f"<table><tbody><tr>{cells}</tr><tr>{bad}</tr></tbody></table>"
    typed, rejected = C.city_table(spark.createDataFrame([("MA", "nordeste", page)], "state string, region string, content string"))
    row = typed.first()
    assert (row["cidade"], row["populacao"], row["pib"], row["area"]) == ("S. Luís", 1452275, 9.25, "1059.46")
    assert typed.count() == 1 and rejected.count() == 1


def test_cast_with_rejects_keeps_nulls(spark):
    df = spark.createDataFrame([("1",), (None,), ("x",)], "a string")
    good, bad = cast_with_rejects(df, {"a": "int"})
    assert sorted((r["a"] for r in good.collect()), key=str) == [1, None] and bad.count() == 1


def test_pages_in_two_encodings(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("São Luís".encode("utf-8"))
    (tmp_path / "b.html").write_bytes("São Luís".encode("latin-1"))
    assert {r["text"] for r in S.read_pages(spark, str(tmp_path)).collect()} == {"São Luís"}


def test_collection_of_problems(spark, tmp_path):
    from analystry.plans.authorship import read_collection
    (tmp_path / "collection-info.json").write_text(json.dumps(
        [{"problem-name": "p1", "language": "en", "encoding": "UTF-8"}, {"problem-name": "p2", "language": "fr", "encoding": "UTF-8"}]))
    for p in ("p1", "p2"):
        os.makedirs(tmp_path / p)
        (tmp_path / p / "problem-info.json").write_text(json.dumps(
            {"unknown-folder": "unknown", "candidate-authors": [{"author-name": "c1"}, {"author-name": "c2"}]}))
        for label in ("unknown", "c1", "c2"):
            os.makedirs(tmp_path / p / label)
            (tmp_path / p / label / "t.txt").write_text(f"{p} {label}\nline é", encoding="utf-8")
            (tmp_path / p / label / "note.md").write_text("no")
    rows = {(r["problem"], r["label"]): r for r in read_collection(spark, str(tmp_path)).collect()}
    assert len(rows) == 6
    assert rows[("p1", "unknown")]["role"] == "unknown" and rows[("p2", "c1")]["role"] == "candidate"
    assert rows[("p2", "c1")]["text"] == "p2 c1\nline é" and rows[("p2", "c1")]["language"] == "fr"


def test_archive_skips_what_is_stored(spark, tmp_path):
    page = "var blog_api_answer = " + json.dumps({"posts-total": 1, "posts": [
        {"slug": "s", "type": "photo", "date-gmt": "2020-02-03 1:00", "photo-url-1280": "http://h/a.jpg",
         "photos": [{"photo-url-1280": "http://h/x/b.jpg"}]},
        {"slug": "q", "type": "text", "date-gmt": "2020-02-04", "photos": [{"photo-url-1280": "http://h/no.jpg"}]}]}) + ";"
    pages = spark.createDataFrame([(page,)], "body string")
    photos = A.photos_of(A.posts_of(pages, "body"))
    assert {r["file"] for r in photos.collect()} == {"a.jpg", "b.jpg"}
    out = str(tmp_path / "m")
    assert A.archive(pages, "body", out).first().asDict() == {"year": "2020", "month": "02", "day": "03", "posts": 1, "photos": 2}
    assert A.new_photos(photos, A.read_manifest(spark, out)).count() == 0


def test_stream_drops_a_photo_seen_again(spark, tmp_path):
    from analystry.streaming.archive import archive_stream
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.makedirs(source)
    body = "var blog_api_answer = " + json.dumps({"posts": [
        {"slug": "s", "type": "text", "date-gmt": "2020-02-03", "photo-url-1280": "http://h/a.jpg"}]}) + ";"
    for i in range(2):
        with open(os.path.join(source, f"{i}.txt"), "w") as f:
            f.write(body)
        assert archive_stream(spark, source, target, state).count() == 1


def test_archive_takes_the_main_photo_in_any_order_and_counts_new_ones(spark, tmp_path):
    photo = {"slug": "s", "type": "photo", "date-gmt": "2012-03-04 05:06:07 GMT", "photo-url-1280": "http://main/x/a.jpg",
             "photos": [{"photo-url-1280": "http://other/x/a.jpg"}, {"photo-url-1280": "http://other/x/b.jpg"}]}
    body = lambda posts: "var tumblr_api_read = " + json.dumps({"posts-total": len(posts), "posts": posts}) + ";"
    again = {**photo, "photo-url-1280": "http://third/x/a.jpg"}
    for k, posts in enumerate(([photo, again], [again, photo])):
        urls = A.new_photos(A.photos_of(A.posts_of(spark.createDataFrame([(body(posts),)], "b string"), "b")), None).select("file", "url").collect()
        assert {r["file"]: r["url"] for r in urls} == {"a.jpg": "http://main/x/a.jpg", "b.jpg": "http://other/x/b.jpg"}
    path = str(tmp_path / "manifest")
    first = A.archive(spark.createDataFrame([(body([photo]),)], "b string"), "b", path)
    assert [tuple(r) for r in first.collect()] == [("2012", "03", "04", 1, 2)]
    later = {**photo, "slug": "t", "photos": []}
    second = A.archive(spark.createDataFrame([(body([photo, later]),)], "b string"), "b", path, A.read_manifest(spark, path))
    assert [tuple(r) for r in second.collect()] == [("2012", "03", "04", 1, 1)]


def test_pages_are_counted_off(spark):
    assert [r[0] for r in A.page_ranges(spark.range(120)).orderBy("start").collect()] == [0, 50, 100]
    assert A.page_ranges(spark.range(0)).count() == 0


def test_char_ngrams_are_found_without_a_lambda_per_character(spark):
    text = "a\U0001F600b\nc"
    df = spark.createDataFrame([(text,), ("ab",), ("",), (None,)], "t string")
    found = df.select(T.char_ngrams(F.col("t"), 3, 3).alias("g"))
    assert [r["g"] for r in found.collect()] == [[text[:3], text[1:4], text[2:]], [], [], []]
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_labelled_texts_are_one_plain_file_each(spark, tmp_path):
    want = [("en", "a", "one"), ("en", "a", "one"), ("en", None, "two\nlines"), ("", "b c", ""), ("fr", "b", None)]
    df = spark.createDataFrame(want, "lang string, source string, text string")
    path = str(tmp_path / "texts")
    S.write_labelled_texts(df, path, ["lang", "source"])
    files = [f for _, _, names in os.walk(path) for f in names]
    # no second file with check sums, which Hadoop's local file system adds
    assert len(files) == 5 and all(f.endswith(".txt") for f in files)
    none = S.NO_PROBLEM
    got = sorted((r["problem"], r["label"], r["text"]) for r in S.read_labelled_texts(spark, path).collect())
    assert got == sorted([("en", "a", "one\n"), ("en", "a", "one\n"), ("en", none, "two\nlines\n"), (none, "b c", "\n"), ("fr", "b", "\n")])


def test_labelled_text_files_makes_one_file_per_text(spark, tmp_path):
    from analystry.registry import QUERIES
    from analystry.session import shared_folder

    spark.createDataFrame([(i, f"text {i % 7}", "en", "s") for i in range(20)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    base = os.path.join(shared_folder(spark), "analystry")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    assert sum(r["n"] for r in QUERIES["labelled_text_files"](spark, str(tmp_path)).collect()) == 20
    [new] = set(os.listdir(base)) - before
    assert sum(len(names) for _, _, names in os.walk(os.path.join(base, new))) == 20


def test_texts_are_listed_and_read_by_the_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "TASK_TEXTS", 3)
    path = tmp_path / "texts"
    made = [("lang=é a", "source=b%2Fc+d"), ("x", "y"), ("_p=1", "=z"), ("_left", "out"), (".left", "out")]
    for folder in made:
        (path / "top").joinpath(*folder).mkdir(parents=True)
        for i in range(7):
            (path / "top").joinpath(*folder, f"t{i}.txt").write_bytes(b"" if i == 6 else f"one {i}\r\n é".encode() + b"\xff" * (i == 5))
        (path / "top").joinpath(*folder, ".hidden.txt").write_text("no")
    columns = ["problem", "label", "filename", F.hex(F.col("text").cast("binary")).alias("h")]
    got = S.read_labelled_texts(spark, str(path))
    assert "FileScan" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(S, "local_folder", lambda *_: None)
    want = S.read_labelled_texts(spark, str(path))
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert got.count() == 18  # empty files have no row
